"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a row draws one of the children: every child gets a hash draw from the row's key and
the child's name, turned into an exponential time of the child's weight, and the earliest wins. A
child wins with the share of its weight, and when one weight grows, rows move to that child only.
So rows move only within the subtrees whose weights change. Shards are added as a region of their
own, so that one more shard takes rows only into itself.

Everything is an expression over the row; nothing is shuffled to choose a shard. Numbering the rows
of a shard counts rows by shard and hash block first and numbers within the blocks, so no shard is
ever in one task. A null key draws like the text "null". Repeated rows go to the same shard and get
slots of their own; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceworks.llm.common import column

#: Rows of a block of a shard, on average.
BLOCK_ROWS = 50_000

Tree = Sequence[tuple[str, Sequence[tuple[str, Sequence[tuple[int, float]]]]]]


def even_tree(shards: int, grown: int = 0, regions: int = 2, racks: int = 4) -> list:
    """Shards of equal weight dealt over regions and racks in order; ``grown`` more shards are
    regions of their own, each of one rack and one shard."""

    def parts(numbers: list[int], n: int) -> list[list[int]]:
        cuts = [len(numbers) * k // n for k in range(n + 1)]
        return [numbers[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]

    tree = [(f"region{r}", [(f"region{r}/rack{k}", [(s, 1.0) for s in part])
                            for k, part in enumerate(parts(own, racks))])
            for r, own in enumerate(parts(list(range(shards)), regions))]
    return tree + [(f"added{s}", [(f"added{s}/rack0", [(s, 1.0)])])
                   for s in range(shards, shards + grown)]


def tree_literal(tree: Tree) -> Column:
    """The tree as nested arrays of children: name, weight, what is below."""

    def child(name: str, weight: float, below: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"),
                        below.alias("below"))

    weight_of = lambda rack: sum(w for _, w in rack[1])
    return F.array(*[child(region, sum(map(weight_of, racks)), F.array(*[
        child(rack[0], weight_of(rack), F.array(*[
            child(f"{rack[0]}/{number}", weight, F.lit(number)) for number, weight in rack[1]]))
        for rack in racks])) for region, racks in tree])


def draw(key: Column, children: Column) -> Column:
    """What is below the child that wins; of equals, the one whose name sorts first."""

    def time(child: Column) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit("/"), child["name"])), 1, 12)
        share = (F.conv(digits, 16, 10).cast("double") + 1) / float(1 << 48)
        return F.struct((-F.log(share) / child["weight"]).alias("time"), child["name"].alias("name"),
                        child["below"].alias("below"))

    return F.array_min(F.transform(children, time))["below"]


def choose_shard(df: DataFrame, tree: Tree, key: str, out: str) -> DataFrame:
    """Adds the number of the shard that each row's key draws, level by level."""

    text = F.coalesce(column(key).cast("string"), F.lit("null"))
    return df.withColumn(out, draw(text, draw(text, draw(text, tree_literal(tree)))))


def number_rows(df: DataFrame, group: str, order: Sequence[str], out: str) -> DataFrame:
    """Adds numbers without gaps from 0 within each group, in no order that means anything.

    ``order`` names columns that tell rows apart: rows alike in them may share any of the numbers.
    """

    rows = df.count()
    blocks = max(1, -(-rows // BLOCK_ROWS))
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*map(column, order)), F.lit(blocks)).cast("int"))
    sizes = dealt.groupBy(column(group).alias("_group"), F.col("_block").alias("_of")).agg(
        F.count(F.lit(1)).alias("_size"))
    # one row for each group and block, few against the rows
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(
        Window.partitionBy("_group").orderBy("_of").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(group, "_block").orderBy(*map(column, order))) - 1
    return dealt.withColumn("_inside", inside).join(
        before, (column(group) == F.col("_group")) & (F.col("_block") == F.col("_of"))).withColumn(
        out, (F.col("_before") + F.col("_inside")).cast("long")).drop(
        "_block", "_inside", "_group", "_of", "_size", "_before")


def shard_documents(df: DataFrame, shards: int = 40, grown: int = 1, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Key, ``size`` (UTF-8 bytes and 16), ``text_crc32``, ``law``, ``shard``, ``slot`` in the shard
    and ``grown_shard``, the shard with ``grown`` more."""

    binary = F.coalesce(column(text).cast("string"), F.lit("")).cast("binary")
    rows = df.select(column(key).alias("_key"), (F.octet_length(binary) + 16).cast("long").alias("size"),
                     F.crc32(binary).alias("text_crc32"), F.lit("key").alias("law"))
    rows = choose_shard(rows, even_tree(shards), "_key", "shard")
    rows = choose_shard(rows, even_tree(shards, grown), "_key", "grown_shard")
    return number_rows(rows, "shard", ["_key", "text_crc32", "size"], "slot").withColumnRenamed(
        "_key", key)

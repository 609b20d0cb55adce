"""Exact, repeatable splits by row, label and group, and grouped folds.

Rows (or groups) are put in the order of an md5 key, and a split is a range of that order. Only
the keys at the cuts are looked up; every row then finds its split by comparing its own key, so
no table is ever sorted or shuffled for it.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceworks.checks import fresh_name, require_columns
from sliceworks.operators.categories import few_rows
from sliceworks.operators.ordering import (
    if_small, order_key, small_table, smallest_key_cuts, stratum_key_cuts, with_rank,
)
from sliceworks.session import written

SPLITS = ("train", "validation", "test")


def split_sizes(total: int, validation_size: float, test_size: float) -> tuple[int, int]:
    """Rows of test and validation: test first, validation as a share of the rest, rounded up."""

    n_test = math.ceil(total * test_size)
    n_validation = math.ceil((total - n_test) * (validation_size / (1.0 - test_size)))
    return n_test, n_validation


def _by_cuts(key: Column, test: Column, validation: Column) -> Column:
    """Null cuts take no rows."""

    return F.when(key <= test, "test").when(key <= validation, "validation").otherwise("train")


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def split_rows(
    df: DataFrame, id_columns: Sequence[str], *, validation_size: float = 0.15,
    test_size: float = 0.05, seed: int = 42,
) -> DataFrame:
    """Train, validation and test by row. The id must be unique."""

    require_columns(df, id_columns)
    key = order_key(seed, *id_columns)

    def wanted(total: int) -> list[int]:
        n_test, n_validation = split_sizes(total, validation_size, test_size)
        return [n_test, n_test + n_validation]

    _, (test, validation) = smallest_key_cuts(df.select(key.alias("key")), "key", wanted)
    return df.withColumn("split_name", _by_cuts(key, _text(test), _text(validation)))


def split_groups(
    df: DataFrame, group: str, *, validation_size: float = 0.15, test_size: float = 0.05,
    seed: int = 42,
) -> DataFrame:
    """Train, validation and test by group; the shares are shares of groups."""

    require_columns(df, [group])
    key = order_key(seed, group)

    def wanted(total: int) -> list[int]:
        n_test, n_validation = split_sizes(total, validation_size, test_size)
        return [n_test, n_test + n_validation]

    keys = df.select(group).distinct().select(key.alias("key"))
    _, (test, validation) = smallest_key_cuts(keys, "key", wanted)
    return df.withColumn("split_name", _by_cuts(key, _text(test), _text(validation)))


def can_stratify(label_counts: Mapping[str, int], size: float) -> bool:
    """Every class has two rows, and the held-out part has room for every class."""

    if not label_counts or min(label_counts.values()) < 2:
        return False
    return math.ceil(sum(label_counts.values()) * size) >= len(label_counts)


def label_quotas(label_counts: Mapping[str, int], wanted: int) -> dict[str, int]:
    """Share out ``wanted`` rows over the labels by largest remainder, ties by label."""

    total = sum(label_counts.values())
    quotas = {label: wanted * n // total for label, n in label_counts.items()}
    by_remainder = sorted(label_counts, key=lambda x: (-(wanted * label_counts[x] % total), x))
    for label in by_remainder[: wanted - sum(quotas.values())]:
        quotas[label] += 1
    return quotas


def split_stratified(
    df: DataFrame, id_columns: Sequence[str], label: str, *, validation_size: float = 0.15,
    test_size: float = 0.05, seed: int = 42,
) -> DataFrame:
    """Split by row with the label mix kept exactly. The id must be unique, the label filled.

    Each step falls back to a plain split when a class is too small for it.
    """

    require_columns(df, [*id_columns, label])
    if not df.filter(F.col(label).isNull()).isEmpty():
        raise ValueError(f"Label column {label!r} has rows without a value; drop or fill them.")
    text = F.col(label).cast("string")
    # one row per class; a column that is no label has too many
    counts = {row["label"]: row["n"] for row in few_rows(
        df.groupBy(text.alias("label")).agg(F.count(F.lit(1)).alias("n")), f"classes in {label!r}")}
    total = sum(counts.values())
    n_test, n_validation = split_sizes(total, validation_size, test_size)
    within = validation_size / (1.0 - test_size)
    if not can_stratify(counts, test_size):
        return split_rows(df, id_columns, validation_size=validation_size, test_size=test_size,
                          seed=seed)
    test_quota = label_quotas(counts, n_test)
    left = {x: n - test_quota[x] for x, n in counts.items()}
    keep_mix = can_stratify({x: n for x, n in left.items() if n}, within)
    validation_quota = label_quotas(left, n_validation) if keep_mix else dict.fromkeys(left, 0)
    targets = small_table(
        df.sparkSession, [(x, cut, k) for x in counts for cut, k in
         (("test", test_quota[x]), ("validation", test_quota[x] + validation_quota[x])) if k],
        "label string, cut string, k long",
    )
    key = order_key(seed, *id_columns)
    keyed = df.select(text.alias("label"), key.alias("key"))
    # two rows per class
    cuts = {(row["label"], row["cut"]): row["key"]
            for row in stratum_key_cuts(keyed, ["label"], "key", targets).collect()}
    table = small_table(
        df.sparkSession, [(x, cuts.get((x, "test")), cuts.get((x, "validation"))) for x in counts],
        "_label string, _test string, _validation string",
    )
    joined = df.join(table, text.eqNullSafe(F.col("_label")), "left")
    split = _by_cuts(key, F.col("_test"), F.col("_validation"))
    if not keep_mix:
        rest = joined.filter(split != "test").select(key.alias("key"))
        _, (validation,) = smallest_key_cuts(rest, "key", lambda _: [n_validation])
        split = F.when(split == "test", "test").when(key <= _text(validation), "validation") \
            .otherwise("train")
    return joined.withColumn("split_name", split).drop("_label", "_test", "_validation")


def split_summary(df: DataFrame, label: str | None = None) -> DataFrame:
    """Rows and fraction (6 places) per split, or per split and label."""

    keys = ["split_name"] + ([label] if label else [])
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    # a handful of rows: one per split
    everything = Window.partitionBy(F.lit(1))
    per_split = counts.groupBy("split_name").agg(F.sum("row_count").alias("split_rows"))
    per_split = per_split.withColumn("total_rows", F.sum("split_rows").over(everything))
    return counts.join(per_split, "split_name").select(
        *keys, "row_count", "split_rows",
        F.round(F.col("split_rows") / F.col("total_rows"), 6).alias("split_fraction"),
        "total_rows",
    )


def split_membership(df: DataFrame, group: str, row_ids: Sequence[str]) -> DataFrame:
    """Which split every row is in."""

    require_columns(df, [group, *row_ids])
    return df.select("split_name", *dict.fromkeys([group, *row_ids]))


def membership_of(frames: Mapping[str, DataFrame], group: str, row_ids: Sequence[str]) -> DataFrame:
    """The same for tables that were split before."""

    return split_membership(label_splits(frames), group, row_ids)


def label_splits(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Several tables as one with a ``split_name`` column."""

    parts = [frame.withColumn("split_name", F.lit(name)) for name, frame in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def sample_groups(
    df: DataFrame, group: str, sizes: Mapping[str, int], *, seed: int = 42,
) -> DataFrame:
    """Keep whole groups, so many per split; a split with fewer groups is kept whole."""

    key = order_key(seed, group)
    keys = df.select("split_name", group).distinct().select("split_name", key.alias("key"))
    available = keys.groupBy("split_name").agg(F.count(F.lit(1)).alias("groups"))
    wanted = small_table(
        df.sparkSession, [(name, "sample", k) for name, k in sizes.items()], "split_name string, cut string, k long")
    targets = wanted.join(available, "split_name").select(
        "split_name", "cut", F.least("k", "groups").alias("k"))
    cuts = stratum_key_cuts(keys, ["split_name"], "key", targets)
    limits = {row["split_name"]: row["key"] for row in cuts.collect()}
    keep = F.lit(False)
    for name, limit in limits.items():
        keep = keep | ((F.col("split_name") == name) & (key <= limit))
    return df.filter(keep)


def sample_rows(df: DataFrame, id_columns: Sequence[str], limit: int, *, seed: int = 42) -> DataFrame:
    """A repeatable random sample of at most ``limit`` rows.

    Of rows that share the ids at the cut, those of the lowest hash of the whole row are taken, and of
    equal rows as many as are still missing.
    """

    key = order_key(seed, *id_columns)
    total, (cut,) = smallest_key_cuts(df.select(key.alias("key")), "key", lambda n: [min(n, limit)])
    if cut is None:
        return df.filter(F.lit(False))
    below, upto = df.agg(F.count_if(key < cut), F.count_if(key <= cut)).first()
    missing = min(total, limit) - below
    if upto - below == missing:
        return df.filter(key <= cut)
    tied = df.filter(key == cut)
    whole = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    _, (last,) = smallest_key_cuts(tied.select(whole.alias("key")), "key", lambda n: [missing])
    before = tied.filter(whole < last)
    return df.filter(key < cut).unionByName(before).unionByName(
        tied.filter(whole == last).limit(missing - before.count()))


def _turns(class_sizes: Sequence[tuple[int, int]], folds: int) -> list[tuple[int, int, list[int]]]:
    """Deal groups, largest first, each to the lightest fold (the first one on a tie).

    Groups of one size are dealt in turns: the lightest fold alone until it meets the next one,
    then both in rotation, and so on. The result lists ``(size, first position, rotation)``; the
    number of steps depends on the distinct sizes, not on the groups.
    """

    loads = [0] * folds
    turns = []
    for size, amount in class_sizes:
        dealt = 0
        while dealt < amount:
            order = sorted(range(folds), key=lambda f: (loads[f], f))
            active = order[:1]
            waiting = order[1:]
            # extend the rotation with folds the first of it would not overtake in one step
            while waiting and (loads[waiting[0]], waiting[0]) < (
                loads[active[0]] + size, active[0]
            ):
                active.append(waiting.pop(0))
            if waiting:
                level, name = loads[waiting[0]], waiting[0]
                picks = sum(
                    (level - loads[f] + size - 1) // size
                    + (1 if f < name and (level - loads[f]) % size == 0 else 0)
                    for f in active
                )
            else:
                picks = amount - dealt
            picks = min(picks, amount - dealt)
            turns.append((size, dealt, active))
            for place, fold in enumerate(active):
                rounds = picks // len(active) + (1 if place < picks % len(active) else 0)
                loads[fold] += rounds * size
            dealt += picks
    return turns


def split_stratified_by(
    df: DataFrame, group: str, id_columns: Sequence[str], label: str, *, validation_size: float = 0.15,
    test_size: float = 0.05, seed: int = 42,
) -> DataFrame:
    """:func:`split_stratified` within every group at once; rows without a group are left out.

    The sizes of each group's cuts come from its label counts, worked out group by group in tasks; the
    cuts of all groups are looked up together.
    """

    require_columns(df, [group, *id_columns, label])
    text, key = F.col(label).cast("string"), order_key(seed, *id_columns)
    if not df.filter(F.col(group).isNotNull() & text.isNull()).isEmpty():
        raise ValueError(f"Label column {label!r} has rows without a value; drop or fill them.")
    rows = df.filter(F.col(group).isNotNull()).withColumns({"_group": F.col(group), "_label": text, "_key": key})
    counts = rows.groupBy("_group", "_label").agg(F.count(F.lit(1)).alias("n"))
    kind = df.schema[group].dataType.simpleString()
    # the functions travel whole, so that workers need not have this package
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def cuts_of(name: tuple, table: pa.Table) -> pa.Table:
        found = dict(zip(table["_label"].to_pylist(), table["n"].to_pylist(), strict=True))
        total = sum(found.values())
        n_test, n_validation = split_sizes(total, validation_size, test_size)
        if not can_stratify(found, test_size):
            out = [("plain", None, "test", n_test), ("plain", None, "validation", n_test + n_validation)]
        else:
            test = label_quotas(found, n_test)
            left = {x: n - test[x] for x, n in found.items()}
            mixed = can_stratify({x: n for x, n in left.items() if n}, validation_size / (1.0 - test_size))
            out = [("mixed" if mixed else "rest", x, "test", n) for x, n in test.items()]
            if mixed:
                more = label_quotas(left, n_validation)
                out += [("mixed", x, "validation", test[x] + n) for x, n in more.items()]
            else:
                out.append(("rest", None, "validation", n_validation))
        modes, labels, cuts, sizes = zip(*out, strict=True)
        return pa.table({"_group": pa.array([name[0].as_py()] * len(out), table["_group"].type), "mode": modes,
                         "_label": pa.array(labels, pa.string()), "cut": cuts, "k": pa.array(sizes, pa.int64())})

    plan = written(counts.groupBy("_group").applyInArrow(
        cuts_of, f"_group {kind}, mode string, _label string, cut string, k long"), "cuts")
    asked = plan.filter("k > 0")

    def wide(found: DataFrame, by: list[str], prefix: str) -> DataFrame:
        return if_small(found.groupBy(*by).agg(*[
            F.max(F.when(F.col("cut") == c, F.col("_key"))).alias(f"{prefix}{c}") for c in ("test", "validation")]))

    keyed = rows.select("_group", "_label", "_key")
    labelled = stratum_key_cuts(keyed, ["_group", "_label"], "_key", asked.filter("_label IS NOT NULL").select(
        "_group", "_label", "cut", "k"))
    plain = stratum_key_cuts(keyed.drop("_label"), ["_group"], "_key", asked.filter("mode = 'plain'").select(
        "_group", "cut", "k"))
    split = _by_cuts(F.col("_key"), F.coalesce("_l_test", "_g_test"), F.coalesce("_l_validation", "_g_validation"))
    joined = rows.join(wide(labelled, ["_group", "_label"], "_l_"), ["_group", "_label"], "left").join(
        wide(plain, ["_group"], "_g_"), "_group", "left").withColumn("split_name", split)
    rest = asked.filter("mode = 'rest' AND cut = 'validation'").select("_group", "cut", "k")
    if not rest.isEmpty():  # too few rows to keep the mix in validation: the first of what is left
        last = stratum_key_cuts(joined.filter("split_name <> 'test'").select("_group", "_key"), ["_group"], "_key", rest)
        joined = joined.join(wide(last, ["_group"], "_r_"), "_group", "left").withColumn("split_name", F.when(
            (F.col("split_name") != "test") & (F.col("_key") <= F.col("_r_validation")), "validation").otherwise(
            F.col("split_name")))
    return joined.select(*df.columns, "split_name")


#: Portions that a class of equal groups is dealt in at first, and classes written at a time.
STEPS, CLASSES = 1024, 50_000


class _Balance:
    """Label counts of folds, and which fold a group leaves the labels' shares least spread over.

    The spread of a label is the deviation, over folds, of the share of its rows that a fold holds;
    it does not change when all folds get the same, so choices repeat once each fold had its turn.
    """

    def __init__(self, totals: Mapping[str | None, int], folds: int) -> None:
        self.totals, self.folds, self.rows = totals, folds, [0] * folds
        self.counts = {label: [0] * folds for label in totals}
        self.sums = {label: (0, 0) for label in totals}

    def _spread(self, label: str | None, fold: int | None, n: int) -> float:
        one, two = self.sums[label]
        if fold is not None:
            one, two = one + n, two + 2 * n * self.counts[label][fold] + n * n
        return math.sqrt(self.folds * two - one * one) / (self.folds * self.totals[label])

    def best(self, group: Sequence[tuple[str | None, int]]) -> int:
        """Least spread (to ten digits), then fewest rows, then the first fold."""

        old = sum(self._spread(label, None, 0) for label, _ in group)
        change = [round(sum(self._spread(label, f, n) for label, n in group) - old, 10)
                  for f in range(self.folds)]
        return min(range(self.folds), key=lambda f: (change[f], self.rows[f], f))

    def add(self, group: Sequence[tuple[str | None, int]], fold: int, times: int) -> None:
        for label, n in group:
            one, two = self.sums[label]
            n, old = n * times, self.counts[label][fold]
            self.sums[label] = one + n, two + 2 * n * old + n * n
            self.counts[label][fold] = old + n
            self.rows[fold] += n

    def deal(self, group: Sequence[tuple[str | None, int]], amount: int) -> list[tuple[int, list[int]]]:
        """Folds of so many equal groups as ``(first position, rotation)``: one after the other to the
        best fold, large amounts in portions, until each fold had its turn and the turns repeat. Portions
        then get smaller, down to single groups."""

        turns, last, dealt, portion = [], [], 0, max(1, amount // STEPS)
        while dealt < amount:
            left = amount - dealt
            if portion > 1 and portion * self.folds > left:
                portion, last = portion // 2, []
                continue
            fold = self.best([(label, n * portion) for label, n in group])
            rotation = last[-self.folds:]
            if len(set(rotation)) == self.folds and rotation[0] == fold:
                cycles = left // (portion * self.folds)
                amount_now = left if portion == 1 else cycles * portion * self.folds
                turns.append((dealt, rotation))
                for place, f in enumerate(rotation):
                    self.add(group, f, (amount_now - place + self.folds - 1) // self.folds)
                dealt, portion, last = dealt + amount_now, max(1, portion // 2), []
                continue
            if not turns or turns[-1][1] != [fold]:
                turns.append((dealt, [fold]))
            last = [*rotation, fold]
            self.add(group, fold, portion)
            dealt += portion
        return turns


def stratified_group_folds(
    df: DataFrame, group: str, label: str, folds: int, *, seed: int = 42
) -> DataFrame:
    """One row per group: its rows, its majority label and its fold, so that each fold holds about the
    same share of every label.

    Groups are dealt in order of how uneven their label counts are, each to the fold that leaves the
    labels' shares least spread. Groups with equal label counts are one class, dealt at once; the
    classes pass through the driver one by one. Null labels are a label, rows without a group a group.
    """

    require_columns(df, [group, label])
    per_label = df.groupBy(group, F.col(label).cast("string").alias("_label")).agg(
        F.count(F.lit(1)).alias("_n"))
    totals = {row["_label"]: row["n"] for row in few_rows(
        per_label.groupBy("_label").agg(F.sum("_n").alias("n")), f"labels in {label!r}")}
    vector = F.array_sort(F.collect_list(F.struct(F.col("_label").alias("label"), F.col("_n").alias("n"))))
    groups = written(per_label.groupBy(group).agg(
        F.sum("_n").cast("long").alias("group_rows"),
        F.min(F.struct(-F.col("_n"), F.col("_label").isNull(), F.col("_label").alias("name")))["name"]
        .alias("majority_label"), vector.alias("_vector")).withColumn(
        "_class", F.array_join(F.transform("_vector", lambda x: F.concat(
            F.to_json(F.array(x["label"])), x["n"].cast("string"))), "")), "label-counts")
    squares = F.aggregate("_vector", F.lit(0).cast("long"), lambda a, x: a + x["n"] * x["n"])
    classes = groups.groupBy("_class", "_vector", "group_rows").agg(F.count(F.lit(1)).alias("groups")).withColumn(
        "_uneven", squares * len(totals) - F.col("group_rows") * F.col("group_rows")).orderBy(
        F.desc("_uneven"), F.desc("group_rows"), "_class")
    schema = "_class string, turns array<struct<first:long,rotation:array<int>>>"
    balance, deals, tables = _Balance(totals, folds), [], []
    for row in classes.toLocalIterator():
        deals.append((row["_class"], balance.deal([tuple(x) for x in row["_vector"]], row["groups"])))
        if len(deals) == CLASSES:
            tables.append(written(df.sparkSession.createDataFrame(deals, schema), "deals"))
            deals = []
    tables.append(small_table(df.sparkSession, deals, schema))
    ranked = with_rank(groups.withColumn("_key", order_key(seed, group)), ["_class"], "_key", "_rank")
    return _dealt(ranked.join(reduce(DataFrame.unionByName, tables), "_class")).drop("_class", "_vector")


def _dealt(ranked: DataFrame) -> DataFrame:
    """The fold of each group from its rank in its class and the class's turns."""

    position = F.col("_rank") - 1
    turn = F.element_at(F.filter("turns", lambda t: t["first"] <= position), -1)
    place = ((position - turn["first"]) % F.size(turn["rotation"])).cast("int")
    return ranked.withColumn("fold", F.get(turn["rotation"], place)).drop("turns", "_key", "_rank")


def grouped_folds(
    df: DataFrame, group: str, folds: int, *, seed: int = 42, label: str | None = None
) -> DataFrame:
    """One row per group: its rows and its fold, the largest group going to the lightest fold.

    With ``label`` the folds also balance the labels, see :func:`stratified_group_folds`.
    """

    if label:
        return stratified_group_folds(df, group, label, folds, seed=seed)
    require_columns(df, [group])
    return folds_of_sizes(df.groupBy(group).agg(F.count(F.lit(1)).alias("group_rows")), group, folds, seed=seed)


def folds_of_sizes(sizes: DataFrame, group: str, folds: int, *, seed: int = 42) -> DataFrame:
    """The same from one row per group with its ``group_rows``, which is read more than once."""

    # one row per distinct group size (n rows have fewer than sqrt(2n) distinct sizes)
    classes = sizes.groupBy("group_rows").agg(F.count(F.lit(1)).alias("groups")).collect()
    per_size: dict[int, list[tuple[int, list[int]]]] = {}
    for size, first, rotation in _turns(sorted(((r["group_rows"], r["groups"]) for r in classes), reverse=True),
                                        folds):
        per_size.setdefault(size, []).append((first, rotation))
    deal_table = small_table(sizes.sparkSession, list(per_size.items()),
                             "group_rows long, turns array<struct<first:long,rotation:array<int>>>")
    ranked = with_rank(sizes.withColumn("_key", order_key(seed, group)), ["group_rows"], "_key", "_rank")
    return _dealt(ranked.join(deal_table, "group_rows"))


def subset_folds(rows: DataFrame, group: str, folds: int, subsets: Mapping[str, Column], *, seed: int = 42
                 ) -> DataFrame:
    """One row per group with its fold in each subset, in a column of the subset's name.

    A subset is a condition on rows, and its folds are those of :func:`grouped_folds` on the rows that
    meet it; they are null where no row of the group does. The rows are counted once, however many
    subsets there are.
    """

    require_columns(rows, [group])
    counts = written(rows.groupBy(group).agg(
        *[F.count_if(condition).alias(f"_{k}") for k, condition in enumerate(subsets.values())]), "group-sizes")
    dealt = reduce(DataFrame.unionByName, [
        folds_of_sizes(counts.filter(F.col(f"_{k}") > 0).select(group, F.col(f"_{k}").alias("group_rows")), group,
                       folds, seed=seed).select(group, F.lit(k).alias("_subset"), "fold") for k in range(len(subsets))])
    return dealt.groupBy(group).agg(*[
        F.max(F.when(F.col("_subset") == k, F.col("fold"))).alias(name) for k, name in enumerate(subsets)])


def with_folds(
    df: DataFrame, group: str, folds: int, *, seed: int = 42, label: str | None = None
) -> DataFrame:
    """Every row with the fold of its group."""

    name = fresh_name(df, "fold")
    assigned = grouped_folds(df, group, folds, seed=seed, label=label).select(
        F.col(group), F.col("fold").alias(name))
    key = fresh_name(df, "group_of_fold")
    assigned = assigned.withColumnRenamed(group, key)  # rows without a group are a group too
    return df.join(assigned, F.col(group).eqNullSafe(F.col(key))).drop(key)

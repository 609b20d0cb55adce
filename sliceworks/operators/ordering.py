"""Exact order statistics, ranks and running totals that never sort a whole table in one task.

Everything here works in two steps: count rows per bucket of the ordering key (a small table
after map-side combining), then look inside only the buckets that matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Hex digits of an md5 key used as its bucket: 65,536 evenly filled buckets.
PREFIX_DIGITS = 4
# Rows of a bucket that a window orders, and values of a range that one task gathers.
BUCKET_ROWS, GATHERED_VALUES = 100_000, 10_000
# Rows that bounds are drawn from, how finely, and how far from a rank they are taken.
SAMPLE_ROWS, SKETCH, SLACK = 1_000_000, 20_000, 1e-3


# A table of up to this many rows is sent to every task of a join; a larger one is shuffled.
BROADCAST_ROWS = 100_000


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows at hand on the driver as a table, broadcast in joins when they are few enough.

    Spark does not know the size of such a table, and would shuffle the other side to it.
    """

    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table for broadcasting once its size is known to be small; otherwise as it is.

    The check fetches the rows (at most ``limit`` + 1), so a small table is also computed just
    once and no longer depends on its inputs.
    """

    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def order_key(seed: int, *columns: str | Column) -> Column:
    """Pseudo-random but repeatable order of rows: md5 of the seed and the identifying columns.

    Separators inside values are escaped and a null is marked, so that different ids differ.
    """

    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    marked = lambda p: F.contains(p, F.lit("|")) | F.contains(p, F.lit("\\"))
    escaped = [F.coalesce(F.when(marked(p), F.regexp_replace(p, r"([\\|])", r"\\$1")).otherwise(p),
                          F.lit("\\N")) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *escaped))


def _prefix(key: str) -> Column:
    return F.substring(F.col(key), 1, PREFIX_DIGITS)


def smallest_key_cuts(
    keys: DataFrame, key: str, wanted: Callable[[int], Sequence[int]]
) -> tuple[int, list[str | None]]:
    """For each count ``k`` asked for, the md5 key of rank ``k`` (null for ``k`` = 0).

    ``wanted`` gets the number of keys and returns the counts. Only the bucket histogram (at most
    65,536 rows) and the cuts themselves reach the driver.
    """

    histogram = (
        keys.groupBy(_prefix(key).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).toPandas()
        .sort_values("prefix")
    )
    upto = histogram["n"].to_numpy().cumsum()
    total = int(upto[-1]) if len(upto) else 0
    places: list[tuple[str, int] | None] = []
    for k in wanted(total):
        if k <= 0:
            places.append(None)
            continue
        bucket = int(np.searchsorted(upto, min(k, total)))
        before = int(upto[bucket - 1]) if bucket else 0
        places.append((histogram["prefix"].iloc[bucket], min(k, total) - before))
    hits = {place for place in places if place}
    if not hits:
        return total, [None] * len(places)
    in_bucket = Window.partitionBy("prefix").orderBy(key)
    rows = (
        keys.select(key, _prefix(key).alias("prefix"))
        .filter(F.col("prefix").isin(*{prefix for prefix, _ in hits}))
        .withColumn("rank", F.row_number().over(in_bucket))
        .filter(F.col("rank").isin(*{rank for _, rank in hits}))
        .collect()
    )
    found = {(row["prefix"], row["rank"]): row[key] for row in rows}
    return total, [found[place] if place else None for place in places]


def stratum_key_cuts(
    rows: DataFrame, by: Sequence[str], key: str, targets: DataFrame
) -> DataFrame:
    """Like :func:`smallest_key_cuts` inside every stratum, as a table.

    ``targets`` holds ``by``, a name ``cut`` and the count ``k``; the result holds ``by``,
    ``cut`` and the ``key`` of rank ``k``. A stratum with a third of all rows is as evenly
    spread over tasks as any other, because the work is keyed by stratum and bucket.
    """

    by = list(by)
    histogram = rows.groupBy(*by, _prefix(key).alias("_prefix")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    running = Window.partitionBy(*by).orderBy("_prefix")
    places = (
        histogram.withColumn("_upto", F.sum("_n").over(running))
        .join(targets, by)
        .filter((F.col("k") <= F.col("_upto")) & (F.col("k") > F.col("_upto") - F.col("_n")))
        .select(*by, "cut", "_prefix", (F.col("k") - F.col("_upto") + F.col("_n")).alias("_rank"))
    )
    in_bucket = Window.partitionBy(*by, "cut", "_prefix", "_rank").orderBy(key)
    return (
        rows.select(*by, key, _prefix(key).alias("_prefix"))
        .join(if_small(places), [*by, "_prefix"])
        .withColumn("_position", F.row_number().over(in_bucket))
        .filter(F.col("_position") == F.col("_rank"))
        .select(*by, "cut", key)
    )


def with_rank(rows: DataFrame, by: Sequence[str], key: str, name: str = "rank") -> DataFrame:
    """Exact 1-based rank by md5 key inside each stratum, however large the stratum."""

    by = list(by)
    keyed = rows.withColumn("_prefix", _prefix(key))
    running = Window.partitionBy(*by).orderBy("_prefix")
    offsets = (
        keyed.groupBy(*by, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(running) - F.col("_n"))
        .drop("_n")
    )
    in_bucket = Window.partitionBy(*by, "_prefix").orderBy(key)
    return (
        keyed.withColumn("_position", F.row_number().over(in_bucket))
        .join(offsets, [*by, "_prefix"])
        .withColumn(name, F.col("_before") + F.col("_position"))
        .drop("_prefix", "_before", "_position")
    )


def with_running_totals(
    rows: DataFrame, order: str, amounts: Mapping[str, str], by: Sequence[str] = (),
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Sum of each amount over the rows *before* this one in the order of a double column.

    ``rows`` has one row per (``by``, ``order``). Buckets of about ``bucket_rows`` rows are cut at
    quantiles of a sample; the cuts only balance the work, the totals are exact. A null comes first
    and NaN last, after infinity.
    """

    by = list(by)
    size = rows.count()
    buckets = -(-size // bucket_rows)
    cuts = []
    if buckets > 1:
        value = F.when(_drawn(size), F.col(order))
        cuts = rows.withColumn("_draw", F.rand(17)).agg(F.percentile_approx(
            value, [i / buckets for i in range(1, buckets)], SKETCH)).first()[0] or []
    edges = sorted({cut for cut in cuts if math.isfinite(cut)})
    splits = [-math.inf, *edges, math.inf] if edges else [-math.inf, 0.0, math.inf]
    keyed = Bucketizer(splits=splits, inputCol=order, outputCol="_bucket",
                       handleInvalid="keep").transform(rows)
    keyed = keyed.withColumn("_bucket", F.when(F.col(order).isNull(), -1.0).otherwise(F.col("_bucket")))
    running = Window.partitionBy(*by).orderBy("_bucket")
    offsets = keyed.groupBy(*by, "_bucket").agg(
        *[F.sum(a).alias(f"_sum_{a}") for a in amounts]
    )
    offsets = offsets.select(
        *by, "_bucket",
        *[(F.sum(f"_sum_{a}").over(running) - F.col(f"_sum_{a}")).alias(f"_off_{a}")
          for a in amounts],
    )
    earlier = (
        Window.partitionBy(*by, "_bucket").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    for amount, name in amounts.items():
        keyed = keyed.withColumn(name, F.coalesce(F.sum(amount).over(earlier), F.lit(0)))
    joined = keyed.join(offsets, [*by, "_bucket"])
    for amount, name in amounts.items():
        joined = joined.withColumn(name, F.col(name) + F.col(f"_off_{amount}"))
    return joined.drop("_bucket", *[f"_off_{a}" for a in amounts])


def _drawn(size: int) -> Column:
    """Whether a row, by its ``_draw``, belongs to a bounded sample; only work depends on it."""

    return F.col("_draw") < SAMPLE_ROWS / size if size > SAMPLE_ROWS else F.lit(True)


class _Ranks:
    """What is known of one column: how many values lie below and up to each value looked at."""

    def __init__(self, total: int, probabilities: Sequence[float]) -> None:
        self.total, self.known = total, {}
        self.places = [p * (total - 1) for p in probabilities]
        self.ranks = sorted({r for x in self.places for r in (math.floor(x), math.ceil(x))}) if total else []
        self.found: dict[int, float] = {}

    def learn(self, value: float, below: int, upto: int) -> None:
        self.known[value] = (below, upto)
        for r in self.ranks:
            if below <= r < upto:
                self.found[r] = value

    def gaps(self) -> dict[tuple, list[int]]:
        """Open ranges (low, high; null for no bound) with the ranks that lie inside."""

        out: dict[tuple, list[int]] = {}
        for r in self.ranks:
            if r not in self.found:
                low = max((v for v, (_, upto) in self.known.items() if upto <= r), default=None)
                high = min((v for v, (below, _) in self.known.items() if below > r), default=None)
                out.setdefault((low, high), []).append(r)
        return out

    def start(self, gap: tuple) -> int:
        return 0 if gap[0] is None else self.known[gap[0]][1]

    def size(self, gap: tuple) -> int:
        return (self.total if gap[1] is None else self.known[gap[1]][0]) - self.start(gap)

    def answers(self) -> list[float | None]:
        if not self.total:
            return [None] * len(self.places)
        result = []
        for place in self.places:
            low, high = self.found[math.floor(place)], self.found[math.ceil(place)]
            share = place - math.floor(place)
            result.append(low if share == 0 or low == high else (1 - share) * low + share * high)
        return result


def exact_quantiles(
    df: DataFrame, requests: Mapping[str, Sequence[float]], limit: int = GATHERED_VALUES,
) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of double columns, nulls and NaN left out.

    All columns and ranks are narrowed together, so the number of passes depends on the number of rows
    only. A pass draws bounds around every open rank from a bounded sample, then counts the values
    below and at the bounds: a poor sample costs a pass, never the answer, and a value that a third
    of all rows hold becomes a bound and is answered from its count. Ranges with at most ``limit``
    values are gathered. Infinities are values.
    """

    columns = list(requests)
    if not columns:
        return {}
    names = {c: f"_q{k}" for k, c in enumerate(columns)}
    numbers = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(n) for c, n in names.items()])
    totals = numbers.agg(*[F.count(n).alias(n) for n in names.values()]).first()
    state = {n: _Ranks(totals[n], requests[c]) for c, n in names.items()}

    def inside(name: str, gap: tuple) -> Column:
        v = F.col(name)
        return F.when(((v > gap[0]) if gap[0] is not None else F.lit(True))
                      & ((v < gap[1]) if gap[1] is not None else F.lit(True)), v)

    while wide := [(n, gap, ranks) for n, s in state.items() for gap, ranks in s.gaps().items()
                   if s.size(gap) > limit]:
        asks = []
        for k, (n, gap, ranks) in enumerate(wide):
            size, start = state[n].size(gap), state[n].start(gap)
            place = lambda r, side: min(1.0, max(0.0, (r - start + 0.5) / size + side))  # noqa: B023, E731
            near = {place(r, -SLACK) for r in ranks if r - 1 not in ranks} | {
                place(r, SLACK) for r in ranks if r + 1 not in ranks}
            asks.append(F.percentile_approx(
                F.when(_drawn(size), inside(n, gap)), sorted(near), SKETCH).alias(str(k)))
        bounds = numbers.withColumn("_draw", F.rand(17)).agg(*asks).first()
        looked_at = sorted({(n, b) for k, (n, _, _) in enumerate(wide) for b in bounds[str(k)] or ()})
        counts = numbers.agg(*[
            count.alias(f"{k}{side}") for k, (n, b) in enumerate(looked_at)
            for side, count in (("b", F.count_if(F.col(n) < b)), ("u", F.count_if(F.col(n) <= b)))]
            or [F.count(F.lit(1))]).first()
        for k, (n, b) in enumerate(looked_at):
            state[n].learn(b, counts[f"{k}b"], counts[f"{k}u"])
    rest = [(n, gap, ranks) for n, s in state.items() for gap, ranks in s.gaps().items()]
    if rest:
        picks = [F.array(*[F.get(f"_sorted{k}", F.lit(r - state[n].start(gap))) for r in ranks]).alias(str(k))
                 for k, (n, gap, ranks) in enumerate(rest)]
        gathered = numbers.agg(*[F.sort_array(F.collect_list(inside(n, gap))).alias(f"_sorted{k}")
                                 for k, (n, gap, _) in enumerate(rest)])
        row = gathered.select(*picks).first()
        for k, (n, _, ranks) in enumerate(rest):
            state[n].found.update(zip(ranks, row[str(k)], strict=True))
    return {c: state[n].answers() for c, n in names.items()}

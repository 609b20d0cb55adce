"""Order statistics, splits, audits, policies, targets, slices."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sliceworks.operators.audit import assert_split_checks, assert_split_integrity, split_checks
from sliceworks.operators.metrics import regression_metrics, roc_auc
from sliceworks.operators.ordering import (
    exact_quantiles, if_small, order_key, with_rank, with_running_totals,
)
from sliceworks.operators.policy import (
    fixed_split_design, policy_audit, project_roles, regression_design,
)
from sliceworks.operators.profile import histogram, varying
from sliceworks.operators.slices import (
    Bucketer, apply_buckets, error_dominance, feature_gain, fit_buckets, predictions,
    slice_metrics, variant_gap, worst_slices,
)
from sliceworks.operators.splits import (
    _turns, can_stratify, grouped_folds, label_quotas, membership_of, sample_groups, sample_rows,
    split_groups, split_rows, split_sizes, split_stratified, with_folds,
)
from sliceworks.operators.subsets import filter_like_saved, filter_subset, filter_variants
from sliceworks.operators.target import agreement_target, join_target, target_summary


@pytest.mark.parametrize("limit", [10**6, 500, 20])
def test_quantiles_are_exact_at_any_limit(spark, limit):
    rng = np.random.default_rng(1)
    # a third of all rows share one value
    values = np.concatenate([rng.normal(size=2000), np.full(1000, 0.25), rng.integers(0, 3, 100)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    probabilities = [0, 0.1, 0.25, 0.5, 0.66, 0.75, 0.99, 1]
    got = exact_quantiles(df, {"x": probabilities}, limit=limit)["x"]
    assert got == pytest.approx(list(np.quantile(values, probabilities)))


def test_rank_and_running_totals(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") < 300, "hot").otherwise("cold"))
    ranked = with_rank(df.withColumn("k", order_key(1, "id")), ["g"], "k")
    assert ranked.groupBy("g").agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).orderBy(
        "g").collect() == [("cold", 1, 200, 200), ("hot", 1, 300, 300)]
    rows = spark.range(1000).select((F.col("id") / 7).alias("x"), F.lit(2).alias("n"))
    for limit in (10**6, 10):
        total = with_running_totals(rows, "x", {"n": "before"}, bucket_rows=limit)
        assert total.filter(F.abs(F.col("before") - F.round(F.col("x") * 7) * 2) > 1e-9).count() == 0


def test_broadcast_only_when_small(spark):
    assert "BroadcastHint" in str(if_small(spark.range(5))._jdf.queryExecution().logical()) or \
        "hint" in str(if_small(spark.range(5))._jdf.queryExecution().logical()).lower()
    big = spark.range(50)
    assert if_small(big, limit=10) is big


def test_turns_against_one_by_one():
    rng = random.Random(5)
    for _ in range(200):
        folds = rng.randint(2, 5)
        sizes = sorted((rng.choice([1, 2, 3, 5, 8, 13]) for _ in range(rng.randint(1, 60))), reverse=True)
        loads, dealt = [0] * folds, []
        for size in sizes:
            fold = min(range(folds), key=lambda f: (loads[f], f))
            loads[fold] += size
            dealt.append(fold)
        got = []
        classes = sorted(Counter(sizes).items(), reverse=True)
        turns = _turns(classes, folds)
        for size, amount in classes:
            mine = [(first, order) for s, first, order in turns if s == size]
            for place in range(amount):
                first, order = [t for t in mine if t[0] <= place][-1]
                got.append(order[(place - first) % len(order)])
        assert got == dealt


def test_split_sizes():
    assert split_sizes(100, 0.15, 0.05) == (5, 15)
    assert label_quotas({"a": 50, "b": 50}, 5) == {"a": 3, "b": 2}
    assert can_stratify({"a": 2, "b": 50}, 0.05)
    assert not can_stratify({"a": 1, "b": 50}, 0.05)
    assert not can_stratify({str(i): 2 for i in range(10)}, 0.05)


def test_stratified_split_keeps_the_mix(spark):
    df = spark.range(100).withColumn("y", F.when(F.col("id") < 50, "a").otherwise("b"))
    split = split_stratified(df, ["id"], "y")
    counts = {tuple(r[:2]): r[2] for r in split.groupBy("split_name", "y").count().collect()}
    assert sum(n for (s, _), n in counts.items() if s == "train") == 80
    assert sum(n for (s, _), n in counts.items() if s == "validation") == 15
    assert counts["test", "a"] + counts["test", "b"] == 5
    again = split_stratified(df.repartition(7), ["id"], "y")
    assert sorted(split.collect()) == sorted(again.collect())


def test_row_split_and_sample(spark):
    df = spark.range(100)
    assert dict(split_rows(df, ["id"]).groupBy("split_name").count().collect()) == {
        "train": 80, "validation": 15, "test": 5}
    assert sample_rows(df, ["id"], 10).count() == 10
    assert sample_rows(df, ["id"], 1000).count() == 100


def test_group_split_has_no_overlap(spark):
    # one group holds a third of all rows
    df = spark.range(300).withColumn("g", F.when(F.col("id") < 100, 0).otherwise(F.col("id") % 40))
    split = split_groups(df, "g")
    audit = assert_split_integrity(split, "g", ["id"])
    assert {r["split_name"]: r["group_count"] for r in audit.counts.collect()} == {
        "train": 32, "validation": 6, "test": 2}
    sample = sample_groups(split, "g", {"train": 5, "validation": 2, "test": 99})
    groups = dict(sample.groupBy("split_name").agg(F.countDistinct("g")).collect())
    assert groups == {"train": 5, "validation": 2, "test": 2}
    whole = split.join(sample.select("g").distinct(), "g")
    assert whole.count() == sample.count()


def test_audit_raises_on_leak_and_repeated_id(spark):
    frame = lambda rows: spark.createDataFrame(rows, "g string, i int")
    clean = {"train": frame([("g1", 1), ("g1", 2), ("g2", 3)]), "validation": frame([("g3", 4)]),
             "test": frame([("g4", 5)])}
    assert membership_of(clean, "g", ["i"]).count() == 5
    assert_split_integrity(membership_of(clean, "g", ["i"]), "g", ["i"])
    with pytest.raises(ValueError, match="train__validation"):
        assert_split_integrity(
            membership_of({**clean, "validation": frame([("g1", 4)])}, "g", ["i"]), "g", ["i"])
    with pytest.raises(ValueError, match="Duplicate"):
        assert_split_integrity(
            membership_of({**clean, "test": frame([("g4", 5), ("g4", 5)])}, "g", ["i"]), "g", ["i"])


def test_folds_keep_groups_whole(spark):
    df = spark.range(200).withColumn("g", F.when(F.col("id") < 70, -1).otherwise(F.col("id") % 30))
    rows = with_folds(df, "g", 3)
    assert rows.count() == 200
    assert rows.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    assert dict(grouped_folds(df, "g", 3).groupBy("fold").agg(F.sum("group_rows")).collect())[0] == 70


def test_split_checks_report_and_raise(spark):
    df = spark.createDataFrame(
        [("train", 0.5, 1.0, None), ("train", 0.5, 1.0, None), ("test", 1.5, None, 1.0)],
        "split_name string, y double, opt double, x double")
    checks = split_checks(df, targets=["y"], features=["x"], varying_target="y")
    failed = {(r["check_name"], r["split_name"]) for r in checks.filter("not passed").collect()}
    assert failed == {("target_range", "test"), ("target_varies", "train"), ("feature_filled", "train")}
    with pytest.raises(ValueError, match="target_varies"):
        assert_split_checks(checks)


def test_subsets(spark):
    df = spark.createDataFrame([(6, "a", True), (6, "b", False), (7, "a", True)], "q int, y string, b boolean")
    subset = filter_subset(df, "q", "6", label_column="y")
    assert subset.rows.count() == 2
    assert {r["label"]: r["row_count"] for r in subset.metadata.collect()} == {"a": 1, "b": 1}
    assert filter_like_saved(df, subset.metadata).rows.count() == 2
    assert filter_subset(df, "b", "yes").rows.count() == 2
    with pytest.raises(ValueError, match="no rows"):
        filter_subset(df, "q", "9")
    with pytest.raises(ValueError, match="Both"):
        filter_subset(df, "q", None)
    split = df.withColumn("split_name", F.lit("train"))
    with pytest.raises(ValueError, match="validation"):
        filter_variants(split, "y", ["a"])


def test_target(spark):
    df = spark.createDataFrame([("c1", 4, "1010", "1000"), ("c2", 5, "11100", "11000")],
                               "id string, n int, a string, b string")
    target = agreement_target(df, id_column="id", length="n", observed="a", ideal="b")
    assert [tuple(r)[1:] for r in target.orderBy("id").collect()] == [(1, 0.75), (1, 0.8)]
    assert target_summary(target, ["reliability"]).first()["target_median"] == pytest.approx(0.775)
    bad = spark.createDataFrame([("c1", 2, "111", "000")], "id string, n int, a string, b string")
    with pytest.raises(Exception, match="outside"):
        agreement_target(bad, id_column="id", length="n", observed="a", ideal="b").collect()


def test_join_target_checks(spark):
    features = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    targets = lambda rows: spark.createDataFrame(rows, "id string, y double")
    joined = join_target(features, targets([("a", 1.0), ("b", 2.0)]), id_column="id", target="y")
    assert {r["id"]: r["y"] for r in joined.collect()} == {"a": 1.0, "b": 2.0}
    with pytest.raises(Exception, match="Duplicate"):
        join_target(features, targets([("a", 1.0), ("a", 2.0), ("b", 2.0)]), id_column="id",
                    target="y").collect()
    with pytest.raises(Exception, match="No target"):
        join_target(features, targets([("a", 1.0)]), id_column="id", target="y").collect()


def test_policies(spark):
    df = spark.createDataFrame([("i", "y", 1, 2.0, "x", 5), ("j", "z", 1, 3.0, "x", 6)],
                               "id string, label string, fixed int, good double, leak string, other int")
    audit = {r["column"]: (r["role"], r["dropped_as_constant"], r["is_used"]) for r in policy_audit(
        df, allowed=["fixed", "good", "gone"], forbidden={"leak": "outcome"},
        roles={"id": "id", "label": "label"}).collect()}
    assert audit == {
        "id": ("id", False, False), "label": ("label", False, False), "fixed": ("allowed", True, False),
        "good": ("allowed", False, True), "leak": ("forbidden", False, False),
        "other": ("other", False, False), "gone": ("missing", False, False)}
    design = regression_design(df, id_column="id", target="good", label="label", excluded=["leak"])
    assert design.columns == ["id", "good", "other"]
    with pytest.raises(ValueError, match="non-numeric"):
        regression_design(df, id_column="id", target="leak")
    with pytest.raises(ValueError, match="Target columns among"):
        project_roles(df, features=["good"], targets=["good"], target="good", group="id")


def test_constancy_is_judged_on_train_only(spark):
    df = spark.createDataFrame(
        [("train", 1, 1.0, 2.0, "g"), ("train", 1, 2.0, 3.0, "g"), ("test", 9, 5.0, 4.0, "h")],
        "split_name string, late int, x double, y double, g string")
    design = fixed_split_design(df, target="y", features=["late", "x"], group="g")
    assert design.columns == ["split_name", "g", "y", "x"]
    assert varying(df, ["late", "x"]) == ["late", "x"]


def scored(spark):
    rows = [("f1", "raw", 1.0, 1.5), ("f1", "transpiled", 2.0, 2.0), ("f2", "raw", 3.0, 1.0),
            ("f2", "transpiled", 4.0, 4.5), (None, "raw", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "family string, variant string, y double, p double")
    return predictions(df.withColumn("split_name", F.lit("test")), truth="y", predicted="p")


def test_slices(spark):
    slices = slice_metrics(scored(spark), ["family", "variant", "not_there"])
    rows = {(r["slice_name"], r["slice_value"]): r for r in slices.collect()}
    assert set(rows) == {("overall", "overall"), ("family", "f1"), ("family", "f2"),
                         ("family", "nan"), ("variant", "raw"), ("variant", "transpiled")}
    overall = rows["overall", "overall"]
    assert overall["sample_count"] == 5 and overall["mae"] == pytest.approx(0.6)
    assert overall["r2"] == pytest.approx(1 - 4.5 / 10)
    assert rows["family", "nan"]["r2"] is None
    assert worst_slices(slices, ["family", "overall"], 1).first()["slice_value"] == "f2"


def test_dominance_and_gap(spark):
    shares = error_dominance(scored(spark), "family").collect()
    assert shares[0]["family"] == "f2"
    for name in ("sample_fraction", "absolute_error_fraction", "squared_error_fraction"):
        assert sum(r[name] for r in shares) == pytest.approx(1)
    gap = variant_gap(scored(spark), "variant", "raw", "transpiled").first()
    assert gap["available"] and gap["sharp_difference_flag"]
    assert gap["delta_mae"] == pytest.approx(0.25 - 2.5 / 3)
    assert not variant_gap(scored(spark), "absent", "a", "b").first()["available"]
    alone = variant_gap(scored(spark).filter("variant = 'raw'"), "variant", "raw", "transpiled").first()
    assert alone["available"] and alone["delta_mae"] is None


def test_feature_gain_needs_both_regimes(spark):
    columns = ("split_name string, ablation_name string, model_name string, slice_name string, "
               "slice_value string, sample_count long, mae double, rmse double, r2 double")
    rows = [("test", "without", "m1", "family", "f", 4, 0.5, 0.6, 0.2),
            ("test", "without", "m2", "family", "f", 4, 0.4, 0.5, 0.3),
            ("test", "with", "m1", "family", "f", 5, 0.3, 0.4, 0.4)]
    ask = dict(slice_name="family", slice_value="f", without="without", with_extra="with")
    row = feature_gain(spark.createDataFrame(rows, columns), **ask).first()
    assert row["available"] and row["delta_mae"] == pytest.approx(-0.1)
    assert row["material_improvement_flag"]
    assert not feature_gain(spark.createDataFrame(rows[:2], columns), **ask).first()["available"]


def test_buckets_are_closed_on_the_right(spark):
    train = spark.createDataFrame([(float(v),) for v in range(1, 10)], "x double")
    bucketer = fit_buckets(train, "x", 4)
    assert bucketer.edges[1:-1] == (3.0, 5.0, 7.0)
    got = apply_buckets(spark.createDataFrame([(3.0,), (3.1,), (-9.0,), (99.0,)], "x double"), bucketer)
    assert [r["difficulty_bucket"] for r in got.collect()] == ["q1", "q2", "q1", "q4"]
    tied = fit_buckets(spark.createDataFrame([(1.0,)] * 8, "x double"), "x", 4)
    assert tied.edges[1] < tied.edges[2] < tied.edges[3]
    with pytest.raises(ValueError, match="missing"):
        fit_buckets(spark.createDataFrame([(None,), (1.0,)], "x double"), "x")
    with pytest.raises(Exception, match="missing values"):
        apply_buckets(spark.createDataFrame([(None,)], "x double"), Bucketer("x", (0.0, 1.0))).collect()


def test_regression_metric_conventions(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 1.0),
                                ("c", 1.0, 1.0)], "g string, target_value double, predicted_value double")
    r2 = {r["g"]: r["r2"] for r in regression_metrics(df, ["g"]).collect()}
    assert r2 == {"a": 1.0, "b": 0.0, "c": 0.0}
    assert regression_metrics(df.filter("g = 'c'"), small_r2=None).first()["r2"] is None


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    assert roc_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(3.5 / 4)
    assert roc_auc(df.filter("y = 1"), "y", "s").first()["roc_auc"] is None


def test_constant_histogram(spark):
    df = spark.createDataFrame([(2.0,)] * 3, "x double")
    row = histogram(df, "x").first()
    assert row["bin_count"] == 3 and row["bin_start"] <= 2.0 <= row["bin_end"]


def plain_stratified(groups, folds):
    """Fold of each group (name, key, label counts), dealt one by one to the fold of least spread."""

    labels = sorted({x for *_, v in groups for x in v}, key=lambda x: (x is not None, x or ""))
    totals = {x: sum(v.get(x, 0) for *_, v in groups) for x in labels}
    text = lambda v: "".join(f'["{x}"]{v[x]}' if x is not None else f"[null]{v[x]}" for x in labels if x in v)
    uneven = lambda v: len(labels) * sum(n * n for n in v.values()) - sum(v.values()) ** 2
    counts, out = [dict.fromkeys(labels, 0) for _ in range(folds)], {}
    for name, _, v in sorted(groups, key=lambda g: (-uneven(g[2]), -sum(g[2].values()), text(g[2]), g[1])):
        def spread(fold, v=v):
            shares = [[(c[x] + (v.get(x, 0) if f == fold else 0)) / totals[x] for f, c in enumerate(counts)] for x in labels]
            return round(sum(float(np.std(s)) for s in shares), 9)

        out[name] = min(range(folds), key=lambda f: (spread(f), sum(counts[f].values()), f))
        for x, n in v.items():
            counts[out[name]][x] += n
    return out


@pytest.mark.parametrize("seed", range(4))
def test_stratified_folds_balance_labels(spark, seed):
    """Null labels and null groups stay; folds are those of dealing one by one."""

    import hashlib
    import random

    dice = random.Random(seed)
    rows = [(g if g else None, dice.choice(["a", "b", None, "c"][:2 + seed % 3])) for g in range(120)
            for _ in range(dice.choice([1, 1, 2, 3, 9]))]
    rows += [(500 + k, None) for k in range(20)] + [(900, "a")] * 60
    df = spark.createDataFrame(rows, "g int, y string").repartition(3)
    counted = {}
    for g, y in rows:
        counted.setdefault(g, {}).setdefault(y, 0)
        counted[g][y] += 1
    key = lambda g: hashlib.md5(("42|" + ("\\N" if g is None else str(g))).encode()).hexdigest()
    expected = plain_stratified([(g, key(g), v) for g, v in counted.items()], 4)
    found = grouped_folds(df, "g", 4, label="y").collect()
    assert {r.g: r.fold for r in found} == expected
    assert {r.g: r.group_rows for r in found} == {g: sum(v.values()) for g, v in counted.items()}
    assert with_folds(df, "g", 4, label="y").filter("fold is not null").count() == len(rows)


def test_large_classes_are_dealt_in_few_steps():
    from sliceworks.operators.splits import _Balance

    balance = _Balance({"a": 10 ** 9 + 7, "b": 3 * 10 ** 8}, 3)
    balance.deal([("b", 3 * 10 ** 8)], 1)
    turns = balance.deal([("a", 1)], 10 ** 9 + 7)
    assert len(turns) < 2_000 and turns[0][0] == 0
    assert max(balance.counts["a"]) - min(balance.counts["a"]) <= 1


def test_samples_keep_their_limit_where_ids_repeat(spark):
    rows = [(k // 6, k % 4, None if k % 5 else "x") for k in range(90)]
    df = spark.createDataFrame(rows, "id int, v int, t string").repartition(3)
    for limit in (0, 1, 7, 50, 89, 200):
        found = sample_rows(df, ["id"], limit).collect()
        assert len(found) == min(limit, 90)
        assert sorted(map(str, found)) == sorted(map(str, sample_rows(df, ["id"], limit).collect()))
    assert sample_rows(df.limit(0), ["id"], 5).count() == 0


def test_prediction_files_are_bounded_per_folder(spark, tmp_path):
    """As many files as a folder's rows fill, however many tasks write; null keys and repeated rows stay."""

    from pathlib import Path

    from sliceworks.sources.tables import read_predictions, write_predictions

    df = spark.range(5000).select(
        F.when(F.col("id") < 4000, "a").when(F.col("id") < 4990, "b").alias("ablation_name"), F.lit("m").alias("model_name"),
        F.when(F.col("id") % 2 == 0, "test").otherwise("validation").alias("split_name"),
        (F.col("id") % 700).alias("x")).repartition(16)
    write_predictions(df, str(tmp_path / "p"), rows_per_file=1000)
    files = {}
    for path in Path(tmp_path / "p").rglob("*.parquet"):
        files[str(path.parent)] = files.get(str(path.parent), 0) + 1
    assert len(files) == 6 and max(files.values()) <= 2
    found = read_predictions(spark, str(tmp_path / "p")).groupBy("ablation_name", "split_name").agg(
        F.count("*"), F.sum("x"))
    assert sorted(map(str, found.collect())) == sorted(map(str, df.groupBy("ablation_name", "split_name").agg(
        F.count("*"), F.sum("x")).collect()))
    write_predictions(df.limit(0), str(tmp_path / "none"))


def test_prediction_files_have_a_task_each(spark, tmp_path):
    """No task writes several files, whatever their number, so a task's memory is that of one file."""

    import re
    from pathlib import Path

    from sliceworks.sources.tables import write_predictions

    df = spark.range(20_000).select(
        F.concat(F.lit("r"), F.col("id") % 5).alias("ablation_name"), F.lit("m").alias("model_name"),
        F.lit("test").alias("split_name"), F.col("id").alias("x"))
    write_predictions(df, str(tmp_path / "p"), rows_per_file=400)
    tasks = [re.match(r"part-(\d+)", path.name)[1] for path in Path(tmp_path / "p").rglob("*.parquet")]
    assert len(tasks) == len(set(tasks)) == 50


def test_diagnostics_of_saved_runs_come_from_one_pass(spark):
    from sliceworks.operators.reevaluation import reevaluate

    rows = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, "test").otherwise("validation").alias("split_name"),
        F.when(F.col("id") < 200, "plain").otherwise("extra").alias("ablation_name"), F.lit("m").alias("model_name"),
        (F.col("id") % 5).cast("string").alias("family"), F.when(F.col("id") % 7 < 3, "raw").when(
            F.col("id") % 7 < 6, "other").alias("variant"),
        (F.col("id") % 11).cast("double").alias("target_value"), (F.col("id") % 13).cast("double").alias("predicted_value"))
    rows = rows.withColumn("absolute_error", F.abs(F.col("predicted_value") - F.col("target_value"))).withColumn(
        "squared_error", F.col("absolute_error") * F.col("absolute_error"))
    found = reevaluate(rows, ["family", "variant", "absent"], worst_in=["family"], family="family",
                       variant=("variant", "raw", "other"))
    test = rows.filter("split_name = 'test'")
    same = lambda a, b: sorted(str(plain(r)) for r in a.collect()) == sorted(str(plain(r)) for r in b.collect())
    plain = lambda r: [round(x, 9) if isinstance(x, float) else x if not isinstance(x, list) else [plain(y) for y in x]
                       for x in r]
    assert same(found.slices, slice_metrics(rows, ["family", "variant"]))
    columns = ["split_name", "ablation_name", "model_name", "family", "sample_count", "squared_error_fraction"]
    assert same(found.dominance.select(columns), error_dominance(test).select(columns))
    assert same(found.gaps, variant_gap(test, "variant", "raw", "other"))
    assert found.worst.filter("ablation_name = 'plain'").count() == 5 and found.gain is None
    assert found.worst.filter("slice_rank = 1 AND ablation_name = 'plain'").first()["mae"] == \
        found.slices.filter("split_name = 'test' AND ablation_name = 'plain' AND slice_name = 'family'").agg(F.max("mae")).first()[0]
    nothing = reevaluate(rows.drop("family"), ["variant"], worst_in=["variant"], family="family")
    assert nothing.dominance is None and nothing.gaps is None and nothing.best.count() == 2

"""The paths that only large tables take, forced on small ones and compared with brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import correlation, evaluate, lookup, neighbors, quantiles, ranking, sampling, sequences


@pytest.mark.parametrize("kind", ["spread", "hot", "constant"])
def test_narrowed_quantiles_are_exact(spark, kind):
    rng = random.Random(1)
    values = {
        "spread": [rng.gauss(0, 100) for _ in range(3000)],
        "hot": [7.0 if i % 3 else rng.expovariate(0.01) for i in range(3000)],
        "constant": [4.0] * 500,
    }[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = quantiles.quantiles(df, "x", probs, builtin_rows=0, pick_rows=50, sketch=100)["x"]
    assert found == pytest.approx(list(np.quantile(values, probs)), rel=1e-12, abs=1e-12)


def test_narrowed_quantiles_by_group(spark):
    rng = random.Random(2)
    rows = [("a" if rng.random() < 0.9 else "b", rng.random(), rng.gauss(5, 1)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    found = quantiles.exact_quantiles(df, ["x", "y"], [0.25, 0.5], by="g", builtin_rows=0, pick_rows=30, sketch=100)
    for g in "ab":
        for i, c in ((1, "x"), (2, "y")):
            assert found[g][c] == pytest.approx(list(np.quantile([r[i] for r in rows if r[0] == g], [0.25, 0.5])))


def test_running_totals_over_buckets(spark):
    rng = random.Random(3)
    counts = {float(v): rng.randint(1, 9) for v in {rng.randint(0, 10**6) for _ in range(2000)}}
    df = spark.createDataFrame(list(counts.items()), "v double, n long")
    got = {r["v"]: r["before_n"] for r in ranking.running_totals(df, "v", ["n"], bucket_rows=100).collect()}
    total = 0
    for v in sorted(counts):
        assert got[v] == total
        total += counts[v]


def test_global_index(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), "id").repartition(7)
    rows = ranking.global_index(df, ["k", "id"]).orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(5000))
    assert [(r["k"], r["id"]) for r in rows] == sorted((r["k"], r["id"]) for r in rows)


def test_lookup_with_hot_keys(spark):
    rows = [(None if i % 10 == 0 else "hot" if i % 3 else f"k{i}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long")
    counts = df.filter("k is not null").groupBy("k").agg(F.count("*").alias("n")).filter("k != 'k3'")
    mapping = counts.withColumnRenamed("k", "value").withColumn("code", F.length("value"))
    for options in ({}, {"broadcast_rows": 0}, {"broadcast_bytes": 0}):
        got = lookup.lookup_join(df, mapping, "k", ["code"], **options).collect()
        assert len(got) == 3000
        for r in got:
            want = None if r["k"] in (None, "k3") else len(r["k"])
            assert r["code"] == want


def test_lookup_spreads_an_unmatched_hot_key(spark):
    """A key that the mapping lacks and that holds a third of the rows lands in no single task."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "unseen").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("k"))
    mapping = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("value"), F.col("id").alias("code"))
    adaptive, parts = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup.lookup_join(df, mapping, "k", ["code"], broadcast_rows=0)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 60_000 and max(sizes) < 2 * 60_000 / 16
        assert joined.filter("k = 'unseen' and code is not null").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _tau(xs, ys):
    s = tx = ty = 0
    n = len(xs)
    for i in range(n):
        for j in range(i):
            a, b = np.sign(xs[i] - xs[j]), np.sign(ys[i] - ys[j])
            s += a * b
            tx += a == 0
            ty += b == 0
    pairs = n * (n - 1) / 2
    return s / math.sqrt((pairs - tx) * (pairs - ty))


def test_kendall(spark):
    rng = random.Random(4)
    xs = [5.0 if rng.random() < 0.3 else round(rng.gauss(0, 3), 1) for _ in range(300)]
    ys = [round(x / 2 + rng.gauss(0, 2), 1) for x in xs]
    zs = [rng.choice([1.0, 2.0, None, float("nan")]) for _ in xs]
    df = spark.createDataFrame([*zip(xs, ys, zs), (1.0, None, 1.0)], "x double, y double, z double")
    assert correlation.kendall(df, "x", "y") == pytest.approx(_tau(xs, ys), rel=1e-12)
    got = {(r["x"], r["y"]): r["corr"] for r in correlation.corr_kendall(df, ["x", "y", "z"]).collect()}
    full = [(x, y, z) for x, y, z in zip(xs, ys, zs) if z in (1.0, 2.0)]
    assert got["x", "y"] == got["y", "x"] == pytest.approx(_tau(xs, ys), rel=1e-12)
    assert got["y", "z"] == pytest.approx(_tau([y for _, y, _ in full], [z for *_, z in full]), rel=1e-12)
    assert got["x", "z"] == pytest.approx(_tau([x for x, *_ in full] + [1.0], [z for *_, z in full] + [1.0]), rel=1e-12)
    same = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double")
    assert correlation.kendall(same, "x", "y") is None


def test_metrics_of_many_classes(spark):
    """Classes are summed in Spark: there is no number of them that is refused."""
    rows = [(i % 1500, (i * 7) % 1500 if i % 3 else i % 1500) for i in range(6000)]
    df = spark.createDataFrame(rows, "y int, p int")
    got = evaluate.classification_metrics(df, "y", "p")
    assert got["accuracy"] == pytest.approx(sum(y == p for y, p in rows) / len(rows))
    recall = [sum(p == c for y, p in rows if y == c) / 4 for c in range(0, 1500, 100)]
    assert 0 < got["recall"] < 1 and got["recall"] == pytest.approx(got["accuracy"]) and recall
    small = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "b"), ("b", None)], "y string, p string")
    assert evaluate.classification_metrics(small, "y", "p", "a") == {"accuracy": pytest.approx(2 / 3), "precision": 1.0, "recall": 0.5, "f1_score": pytest.approx(2 / 3)}
    assert evaluate.classification_metrics(small, "y", "p", "z")["f1_score"] == 0.0
    assert sorted(map(tuple, evaluate.confusion_matrix(small, "y", "p").collect())) == [("a", "a", 1), ("a", "b", 1), ("b", "a", 0), ("b", "b", 1)]


def test_samples_of_many_groups(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 12_000).cast("string").alias("g"))
    assert sampling.undersample(df.filter("id >= 10"), "g", "id").count() == 4 * 12_000
    taken = sampling.sample_stratified(df, "g", "id", 24_000)
    assert taken.count() == 24_000 and taken.groupBy("g").count().select("count").distinct().count() == 1


def _ranks(values):
    ordered = sorted(values)
    return [(ordered.index(v) + 1 + ordered.index(v) + ordered.count(v)) / 2 for v in values]


def test_spearman_with_gaps(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 20), rng.randint(0, 20) if rng.random() < 0.8 else None, rng.random()) for _ in range(200)]
    df = spark.createDataFrame(rows, "x int, y int, z double")
    got = {(r["x"], r["y"]): r["corr"] for r in correlation.corr_spearman(df, ["x", "y", "z"]).collect()}
    for a, b in ((0, 1), (0, 2), (1, 2)):
        pairs = [(r[a], r[b]) for r in rows if r[a] is not None and r[b] is not None]
        want = np.corrcoef(_ranks([p[0] for p in pairs]), _ranks([p[1] for p in pairs]))[0, 1]
        assert got["xyz"[a], "xyz"[b]] == pytest.approx(want)


def test_auc_over_buckets(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 1), rng.randint(0, 50) / 10) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert evaluate.roc_auc(df, "y", "s") == pytest.approx(want)
    assert evaluate.roc_auc(df, "y", "s", bucket_rows=5) == pytest.approx(want)


def test_trailing_counts_across_ranges(spark):
    rng = random.Random(7)
    rows = sorted({(k, rng.randint(0, 3000)) for k in ("hot",) * 5 + ("cold",) for _ in range(80)})
    df = spark.createDataFrame([(k, t) for k, t in rows], "k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = sequences.trailing(df, "k", "ts", {"n": (60, F.count("*")), "m": (250, F.max("t"))}, range_seconds=100).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n"] == sum(k == r["k"] and 0 <= r["t"] - t <= 60 for k, t in rows)


def test_previous_across_ranges(spark):
    rows = [("a", i * i, i) for i in range(50)] + [("b", 7, 1)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    got = sequences.previous(df, ["k"], ["seq"], ["v"], F.floor(F.col("seq") / 100)).collect()
    for r in got:
        assert r["prev_v"] == (None if r["k"] == "b" or r["v"] == 0 else r["v"] - 1)


@pytest.mark.parametrize("block_rows", [1000, 40])
def test_nearest_is_exact(spark, block_rows):
    rng = np.random.default_rng(8)
    points = rng.integers(0, 6, (150, 3)).astype(float)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, x array<double>")
    got = {}
    for r in neighbors.nearest(df, df, "id", "x", 4, True, block_rows=block_rows).collect():
        got.setdefault(r["query"], []).append((r["distance"], r["neighbor"]))
    for i, p in enumerate(points):
        want = sorted((float(np.sqrt(((p - o) ** 2).sum())), j) for j, o in enumerate(points) if j != i)[:4]
        assert [n for _, n in sorted(got[i])] == [n for _, n in want]


def test_smote_balances_and_stays_between(spark):
    rows = [(i, "big", [float(i), 0.0]) for i in range(30)] + [(100 + i, "small", [float(i), 5.0]) for i in range(7)]
    df = spark.createDataFrame(rows, "id long, y string, x array<double>")
    made = neighbors.smote(df, "id", "x", "y", 3).collect()
    assert len(made) == 23 and {r["y"] for r in made} == {"small"}
    assert all(0 <= r["x"][0] <= 6 and r["x"][1] == 5.0 for r in made)


def test_class_rank_over_hash_ranges(spark, monkeypatch):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("y"))
    whole = {r["id"]: r["fold"] for r in sampling.stratified_kfold(df, "y", "id").collect()}
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 50)
    cut = {r["id"]: r["fold"] for r in sampling.stratified_kfold(df, "y", "id").collect()}
    assert whole == cut


def test_samples_over_hash_ranges(spark, monkeypatch):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("y"))

    def taken():
        under = {r["id"] for r in sampling.undersample(df, "y", "id").collect()}
        return under, {r["id"] for r in sampling.sample_stratified(df, "y", "id", 900).collect()}

    whole = taken()
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 100)
    assert taken() == whole
    assert len(whole[0]) == 2 * 1334 and len(whole[1]) == 899


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(3000).select("id", (F.col("id") % 4).alias("g"))
    for take in (
        lambda d: sampling.sample_random(d, "id", 100),
        lambda d: sampling.sample_stratified(d, "g", "id", 101),
        lambda d: sampling.undersample(d.filter("g != 0 or id % 8 = 0"), "g", "id"),
    ):
        a = sorted(r["id"] for r in take(df.repartition(3)).collect())
        b = sorted(r["id"] for r in take(df.repartition(9)).collect())
        assert a == b and a
    assert sampling.sample_random(df, "id", 100).count() == 100
    assert sampling.undersample(df.filter("g != 0 or id % 8 = 0"), "g", "id").groupBy("g").count().select("count").distinct().count() == 1

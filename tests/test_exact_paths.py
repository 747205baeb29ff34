"""Attributions, searches, neighbours, trailing sums, split walks and lineage against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewright.modeling import boosting, learners, parzen, sigmoid, training
from tidewright.modeling.closed_form import gram_fold_scores
from tidewright.operators import lineage, logs, neighbors, reduce, sequences, trees
from tidewright.session import scratch_path
from tidewright.streaming import jobs

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def grown(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(160):
        a, b, c = rnd.randrange(5), rnd.randrange(4), rnd.random()
        rows.append((i, float(a), float(b), c, a * (b > 1) + c + rnd.random() / 5, "xyz"[min(2, (a + b) // 3)], "no" if a * c > 1 else "yes"))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, kind string, two string").cache()


def way_value(nodes, x, known):
    """Value of a tree with only the `known` features: others are shared out as the training rows went."""

    def at(i):
        prediction, stats, left, right, feature, threshold, count = nodes[i]
        if left < 0:
            return np.array(prediction)
        if feature in known:
            return at(left if x[feature] <= threshold else right)
        return (nodes[left][6] * at(left) + nodes[right][6] * at(right)) / count

    return at(0)


def brute_shapley(learner, spark, x, shares, weights):
    forest = {}
    for r in trees.tree_nodes(learner, spark).collect():
        count = sum(r["stats"]) if "Classification" in type(learner).__name__ and "GBT" not in type(learner).__name__ else r["stats"][0]
        value = [s / count for s in r["stats"]] if shares else [r["prediction"]]
        forest.setdefault(r["tree"], {})[r["id"]] = (value, r["stats"], r["left"], r["right"], r["feature"], r["threshold"], count)
    d = len(x)
    worth = {s: sum(w * way_value(forest[t], x, s) for t, w in enumerate(weights)) for n in range(d + 1) for s in itertools.combinations(range(d), n)}
    out = []
    for f in range(d):
        total = 0
        for s in worth:
            if f not in s:
                weight = math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d)
                total = total + weight * (worth[tuple(sorted((*s, f)))] - worth[s])
        out.append(total)
    return np.array(out), np.array(worth[()])


@pytest.mark.parametrize(
    "target, algorithm, params, block",
    [
        ("y", "decision_tree_regressor", {"max_depth": 4}, 1 << 20),
        ("kind", "decision_tree_classifier", {"max_depth": 4}, 200),
        ("y", "random_forest_regressor", {"trees": 4, "max_depth": 4}, 500),
        ("kind", "random_forest_classifier", {"trees": 3, "max_depth": 5}, 1 << 20),
        ("y", "gradient_boosting_regressor", {"trees": 4}, 1 << 20),
        ("two", "gradient_boosting_classifier", {"trees": 3}, 1 << 20),
    ],
)
def test_tree_attributions_equal_all_subsets(spark, grown, monkeypatch, target, algorithm, params, block):
    monkeypatch.setattr(trees, "BLOCK_BYTES", block)
    monkeypatch.setattr(trees, "TILE", 4096)
    model = learners.fit(grown, FEATURES, target, algorithm, **params)
    learner = learners.learner_of(model)
    weights = trees._weights(learner)
    some = grown.filter("id < 12").unionByName(spark.createDataFrame([(999, None, 1.0, 0.5, 0.0, "x", "no")], grown.schema))
    got = {}
    for r in trees.shap_tree(model, some, "id", FEATURES, None).collect():
        got[r["id"], r["feature"], r["class"]] = r["shap"]
    assert 999 not in {k[0] for k in got}
    shares = "Classification" in type(learner).__name__ and "GBT" not in type(learner).__name__
    scored = model.transform(grown.filter("id < 12"))
    if shares:
        scored = scored.withColumn("s", vector_to_array("probability"))
    elif "rawPrediction" in scored.columns:
        scored = scored.withColumn("s", F.array(F.element_at(vector_to_array("rawPrediction"), -1)))
    else:
        scored = scored.withColumn("s", F.array("prediction"))
    base = trees.tree_base(model, spark)
    for r in scored.collect():
        x = [r[f] for f in FEATURES]
        want, empty = brute_shapley(learner, spark, x, shares, weights)
        assert np.allclose(base, empty)
        have = np.array([[got[r["id"], f, k] for k in range(len(base))] for f in FEATURES])
        assert np.allclose(have, want, atol=1e-9)
        assert np.allclose(have.sum(axis=0) + base, r["s"], atol=1e-9)


def test_tree_attributions_refuse_other_learners(grown):
    model = learners.fit(grown, FEATURES, "y", "linear_regression")
    with pytest.raises(ValueError):
        trees.shap_tree(model, grown, "id", FEATURES)


def slow_density(low, high, values, at, whole):
    """The mixture by definition, each curve cut at the ends."""
    width, middle = high - low, (low + high) / 2
    centres = sorted([*values, middle])
    total = 0.0
    for i, c in enumerate(centres):
        left, right = ([low, *centres][i], [*centres, high][i + 1])
        s = width if i == centres.index(middle) else min(width, max(width / min(100, len(centres) + 1), c - left, right - c))
        cdf = lambda z: 0.5 * (1 + math.erf((z - c) / s / math.sqrt(2)))
        mass = cdf(high) - cdf(low)
        total += (cdf(at + 0.5) - cdf(at - 0.5)) / mass if whole else math.exp(-0.5 * ((at - c) / s) ** 2) / s / math.sqrt(2 * math.pi) / mass
    return total / len(centres)


def test_parzen_draws_equal_brute_force():
    ranges = {"n": parzen.Range.of([2, 9]), "rate": parzen.Range.of([0.001, 1.0]), "shift": parzen.Range.of([-2.0, 3.0]), "kind": parzen.Range.of(["l1", "l2", None])}
    rnd = random.Random(1)
    done = [({k: r.uniform(rnd) for k, r in ranges.items()}, rnd.random()) for _ in range(30)]
    got = parzen.suggest(ranges, done, random.Random(5))
    order = sorted(done, key=lambda d: -d[1])
    good, rest = [d[0] for d in order[:3]], [d[0] for d in order[3:]]
    rng, want = random.Random(5), {}
    for name, r in ranges.items():
        if r.choices:
            share = lambda some, v: (1 / 3 + sum(p[name] == v for p in some)) / (1 + len(some))  # noqa: B023, E731
            drawn = [rng.choices(r.choices, [share(good, c) for c in r.choices])[0] for _ in range(24)]
            want[name] = max(drawn, key=lambda v: share(good, v) / share(rest, v))
            continue
        low, high = (1.5, 9.5) if name == "n" else (math.log(0.001), 0.0) if name == "rate" else (-2.0, 3.0)
        scale = math.log if name == "rate" else float
        near, far = sorted(scale(p[name]) for p in good), sorted(scale(p[name]) for p in rest)
        density = parzen.Density(r, [p[name] for p in good])
        drawn = [density.draw(rng) for _ in range(24)]
        ratio = lambda v: slow_density(low, high, near, scale(v), name == "n") / slow_density(low, high, far, scale(v), name == "n")  # noqa: B023, E731
        want[name] = max(drawn, key=ratio)
        for v in drawn[:5]:
            assert density.log(v) == pytest.approx(math.log(slow_density(low, high, near, scale(v), name == "n")), rel=1e-9, abs=1e-9)
    assert got == want


def test_parzen_search_is_nearer_than_random_draws():
    ranges = {"x": parzen.Range.of([-10.0, 10.0]), "k": parzen.Range.of([1, 64])}
    score = lambda p: -((p["x"] - 3.3) ** 2) - ((p["k"] - 40) / 8) ** 2
    found, plain = [], []
    for seed in range(8):
        for search, out in ((True, found), (False, plain)):
            rng, done = random.Random(seed), []
            for _ in range(50):
                p = parzen.suggest(ranges, done if search else [], rng)
                done.append((p, score(p)))
            out.append(max(s for _, s in done))
    assert sum(found) > sum(plain) / 2 and sum(a > b for a, b in zip(found, plain)) >= 6


def test_search_goes_on_after_a_failing_set(spark, grown):
    found = training.tune_parzen(grown, FEATURES, "y", "ridge_regression", "id", trials=14, grid={"alpha": [0.01, 100.0]}, batch=3)
    assert len(found["trials"]) == 14 and found["not_run"] == 0
    wrong = training.tune_random(grown, FEATURES, "y", "decision_tree_regressor", "id", trials=2, folds=2, grid={"max_depth": [40, 41]})
    assert [t["score"] for t in wrong["trials"]] == [float("-inf")] * 2


@pytest.mark.parametrize("algorithm", ["ridge_regression", "linear_regression"])
def test_closed_form_scores_equal_fits(grown, algorithm):
    trials = [{"alpha": 0.5}, {"alpha": 30.0}] if algorithm == "ridge_regression" else [{}]
    data = training.with_folds(grown.select("id", "y", *FEATURES), "y", "id", "regression", 3)
    slow = training._fold_scores(data, FEATURES, "y", algorithm, "id", 3, trials)
    quick = gram_fold_scores(data, FEATURES, "y", algorithm, 3)(trials)
    assert np.allclose(slow, quick, atol=1e-6)


def brute_nearest(points, groups, asked, k, self_too):
    out = {}
    for i, x, g in asked:
        found = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), j) for (j, y), h in zip(points, groups) if h == g and (self_too or j != i))
        out[i] = [j for _, j in found[:k]]
    return out


@pytest.mark.parametrize("block_rows, hot, exclude", [(1000, False, True), (15, True, True), (15, True, False)])
def test_nearest_by_pivots(spark, monkeypatch, block_rows, hot, exclude):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", block_rows)  # also cuts the queries of a part into lanes
    rng = np.random.default_rng(3)
    centres = rng.uniform(-50, 50, (12, 3))
    points = [(i, (centres[i % 12] + rng.normal(0, 1, 3)).round(2).tolist()) for i in range(240)]
    if hot:
        points += [(1000 + i, [1.0, 2.0, 3.0]) for i in range(120)]
    rows = [(i, x, "u" if i % 5 else "v") for i, x in points] + [(5000, None, "u"), (5001, [0.0, 0.0, 0.0], None), (5002, [0.0, 1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id long, x array<double>, g string").repartition(5)
    kept = [r for r in rows if r[1] is not None]
    for by in (None, "g"):
        got = {}
        for r in neighbors.nearest(df, df, "id", "x", 3, exclude, by, block_rows).collect():
            got.setdefault(r["query"], {})[r["position"]] = r["neighbor"]
        groups = [r[2] if by else 0 for r in kept]
        want = brute_nearest([(i, x) for i, x, _ in kept], groups, [(i, x, g if by else 0) for i, x, g in kept], 3, not exclude)
        assert {i: [n[p] for p in sorted(n)] for i, n in got.items()} == {i: n for i, n in want.items() if n}


def test_queries_visit_few_cells_when_rows_are_clustered(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.uniform(-1000, 1000, (40, 4))
    df = spark.createDataFrame([(i, (centres[i % 40] + rng.normal(0, 1, 4)).tolist()) for i in range(2000)], "id long, x array<double>")
    routed = []
    plain = neighbors.border_routes
    monkeypatch.setattr(neighbors, "border_routes", lambda asked, cells: routed.append(plain(asked, cells)) or routed[-1])
    assert neighbors.nearest(df, df, "id", "x", 3, True).count() == 6000
    assert routed[0].count() < 3 * 2000  # of 32 cells per query


def test_queries_are_copied_once_per_block_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, rng.normal(0, 1, 24).tolist()) for i in range(3000)], "id long, x array<double>")
    routed = []
    plain = neighbors.border_routes
    monkeypatch.setattr(neighbors, "border_routes", lambda asked, cells: routed.append(plain(asked, cells)) or routed[-1])
    assert neighbors.nearest(df, df, "id", "x", 3, True, block_rows=1000).count() == 9000
    assert routed[0].count() <= 5 * 3000  # of 32 cells, all of which can hold a nearer row


def test_nearest_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, x array<double>")
    some = spark.createDataFrame([(1, [1.0])], "id long, x array<double>")
    assert neighbors.nearest(none, some, "id", "x").count() == 0 == neighbors.nearest(some, none, "id", "x").count()
    assert neighbors.nearest(some, some, "id", "x", exclude_self=True).count() == 0


@pytest.mark.parametrize("edge", [True, False])
def test_trailing_sums_of_a_hot_key(spark, edge):
    rng = random.Random(9)
    rows = [("hot", rng.randint(0, 4000), rng.random()) for _ in range(1500)] + [(f"k{i % 7}", rng.randint(0, 4000), rng.random()) for i in range(60)]
    rows += [(None, 5, 1.0), (None, 9, None), ("hot", None, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, k string, t long, v double").withColumn("ts", F.timestamp_seconds("t"))
    measures = {"n": (60, None), "s": (60, F.col("v")), "wide": (900, F.col("v"))}
    got = {r["id"]: r for r in sequences.trailing_sums(df, "k", "ts", measures, edge).collect()}
    assert len(got) == len(rows)
    for i, (k, t, _) in enumerate(rows):
        if t is None:
            assert got[i]["n"] is None
            continue
        near = lambda span: [v or 0.0 for h, u, v in rows if h == k and u is not None and 0 <= t - u and (t - u <= span if edge else t - u < span)]  # noqa: B023, E731
        assert got[i]["n"] == len(near(60))
        assert got[i]["s"] == pytest.approx(sum(near(60)), abs=1e-8) and got[i]["wide"] == pytest.approx(sum(near(900)), abs=1e-8)


def test_a_hot_key_of_trailing_sums_is_many_ranges(spark):
    df = spark.range(20_000).select(F.lit("one").alias("k"), F.timestamp_seconds("id").alias("ts"))
    laid = df.select(F.col("k").alias("key"), F.unix_micros("ts").alias("us"), F.lit(1).alias("side"), F.col("ts").cast("long").alias("__rid"), F.lit(0).alias("slot"), F.lit(1.0).alias("__v0"))
    found = sequences._range_totals(laid.repartitionByRange(6, "key", "us").sortWithinPartitions("key", "us"), ["__v0"])
    ends = found.filter("slot < 0").collect()
    assert len({r["range"] for r in ends}) == 6
    carried = {r: c for r, c in sequences._carried(ends, ["__v0"])}
    assert carried[0] == 0 and sorted(carried.values()) == [carried[i] for i in range(6)] and 0 < carried[5] < 20_000


def admitted(rows, limits):
    gates, out = {}, {}
    for i, user, t, cost in sorted(rows, key=lambda r: (r[2], r[0])):
        gate = gates.setdefault(user, logs.Admission(limits))
        out[i] = gate.admit(t * 1_000_000, cost)
    return out


@pytest.mark.parametrize("ranges", [1, 9])
def test_admission_over_ranges_equals_the_walk_in_order(spark, ranges):
    rnd, limits = random.Random(2), logs.Limits(3, 40, 200, 9.0)
    rows = [(i, "hot" if i % 4 else rnd.choice(["b", "c", None]), rnd.randint(0, 300_000) // 7 * 7, float(rnd.randint(1, 6))) for i in range(1600)]
    df = spark.createDataFrame(rows, "id long, user string, t long, cost double").withColumn("ts", F.timestamp_seconds("t")).repartition(5)
    got = {r["id"]: (r["allowed"], r["reason"]) for r in logs.admit_requests(df, "user", "ts", "cost", limits, ["id"], ranges).collect()}
    assert got == admitted(rows, limits)
    assert len({v for v in got.values()}) == 3


@pytest.mark.parametrize("graph_rows, walked", [(10**6, 1 << 21), (10**6, 8), (0, 8)])
def test_lineage_of_cycles_and_long_chains(spark, monkeypatch, graph_rows, walked):
    monkeypatch.setattr(lineage, "WALKED", walked)
    deps = {i: [i - 1, None] for i in range(1, 30)} | {0: [], 40: [41, 2], 41: [42], 42: [40, 99], 50: None}
    nodes = spark.createDataFrame(list(deps.items()), "transformation_id long, dependencies array<long>")
    roots = spark.createDataFrame([(29,), (40,), (0,), (77,)], "root long")

    def slow(root, depth):
        near, level = {root: 0}, [root]
        for d in range(1, depth + 1):
            level = [n for i in level for n in deps.get(i) or [] if n is not None and n not in near]
            near.update(dict.fromkeys(level, d))
        return {n: d for n, d in near.items() if n in deps}

    for depth in (3, 10):
        got = {}
        for r in lineage.lineage_chain(nodes, roots, depth, graph_rows).collect():
            got.setdefault(r["root"], {})[r["transformation_id"]] = r["level"]
            assert r["cut"] == (r["level"] == depth and any(d is not None for d in deps[r["transformation_id"]] or []))
        assert got == {r: slow(r, depth) for r in (29, 40, 0)}
    edges = spark.createDataFrame([(a, b) for b, some in deps.items() for a in some or [] if a is not None], "parent_id long, child_id long")
    asked = spark.createDataFrame([(29, 0), (0, 29), (40, 42), (2, 40), (40, 2), (7, 7), (500, 501)], "parent_id long, child_id long")
    found = {(r["parent_id"], r["child_id"]): r["creates_cycle"] for r in lineage.lineage_cycle_check(edges, asked, graph_rows).collect()}
    assert found == {(p, c): c in ({p} | set(slow(p, 100))) for p, c in map(tuple, asked.collect())}


@pytest.mark.parametrize("graph_rows, walked", [(9, 1 << 21), (150, 50)])
def test_lineage_of_large_graphs_writes_links_and_no_pairs(spark, monkeypatch, graph_rows, walked):
    """Ids lead to far fewer others: a core is broadcast, with cycles and ids without links inside and outside."""
    written = []
    keep = lineage.durable
    monkeypatch.setattr(lineage, "durable", lambda df: written.append(keep(df)) or written[-1])
    monkeypatch.setattr(lineage, "WALKED", walked)
    deps = {i: [i // 3, i // 5, None, i // 3] for i in range(300) if i not in (11, 40, 70)}
    deps |= {0: [2], 5: [], 6: None, 200: [], 201: None, 299: [299, 298, 1000], 298: [299], 150: [250], 2000: [2001]}
    names = {i: f"n{i}" for i in [*deps, 11, 40, 70, 1000, 2001, 3000]}

    def slow(root, depth):
        near, level = {root: 0}, [root]
        for d in range(1, depth + 1):
            level = [n for i in level for n in deps.get(i) or [] if n is not None and n not in near]
            near.update(dict.fromkeys(level, d))
        return near

    for kind, name in (("long", dict(zip(names, names))), ("string", names)):
        rows = [(name[i], None if some is None else [None if n is None else name[n] for n in some]) for i, some in deps.items()]
        nodes = spark.createDataFrame(rows, f"transformation_id {kind}, dependencies array<{kind}>").repartition(5)
        roots = [*range(0, 300, 7), 11, 150, 200, 201, 298, 299, 2000, 3000]
        asked = spark.createDataFrame([(name[i],) for i in roots] * 2 + [(None,)], f"root {kind}")
        for depth in (2, 10):
            got = {}
            for r in lineage.lineage_chain(nodes, asked, depth, graph_rows).collect():
                assert r["transformation_id"] not in got.setdefault(r["root"], {})
                got[r["root"]][r["transformation_id"]] = r["level"], r["cut"]
            want = {
                name[i]: {name[n]: (d, d == depth and any(x is not None for x in deps[n] or [])) for n, d in slow(i, depth).items() if n in deps}
                for i in roots
                if i in deps
            }
            assert got == want
        if kind == "long":
            written.clear()
            edges = spark.createDataFrame([(a, b) for b, some in deps.items() for a in some or [] if a is not None], "parent_id long, child_id long")
            pairs = [(p, c) for p in roots for c in (p // 9, p // 7, p, 299, 2, 4000)] * 2 + [(None, 2), (2, None), (None, None)]
            candidates = spark.createDataFrame(pairs, "parent_id long, child_id int")
            checked = lineage.lineage_cycle_check(edges, candidates, graph_rows)
            assert checked.schema["child_id"].dataType.simpleString() == "int"
            found = [tuple(r) for r in checked.collect()]
            assert len(found) == len(set(pairs)) and set(found) == {(p, c, None not in (p, c) and c in slow(p, 400)) for p, c in pairs}
            assert sum(df.count() for df in written) < 2 * len(deps)


@pytest.mark.parametrize("fan_in", [16, 2])
def test_incremental_components_equal_one_fit(spark, monkeypatch, fan_in):
    monkeypatch.setattr(reduce, "FAN_IN", fan_in)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 1e4
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, None)], "id long, v array<double>").repartition(7)
    stored = reduce.StoredScatter(spark, scratch_path(spark, "scatter"))
    for part in range(4):
        held = stored.take(df.filter(F.col("id") % 4 == part), "v")
    assert stored.take(df, "v", 2).rows == held.rows == 300 and stored.last()[0] == 3  # a batch that comes again counts once
    assert stored.take(df.limit(0), "v").rows == 300
    whole = reduce.fit_pca(df.filter("v is not null"), 3, "v")
    again = stored.last()[1].components(3)
    assert np.allclose(whole.loadings, again.loadings, atol=1e-6) and np.allclose(whole.variances, again.variances) and np.allclose(whole.means, again.means)

    folder = scratch_path(spark, "in")
    wide = spark.createDataFrame([(float(a), float(b)) for a, b in x[:, :2]], "a double, b double")
    for part in wide.randomSplit([1.0] * 3, 1):
        part.coalesce(1).write.mode("append").parquet(folder)
    got = jobs.scatter_stream(jobs.file_stream(spark, folder, wide.schema, 1), ["a", "b"], scratch_path(spark, "scatter")).components(2)
    want = reduce.fit_pca(wide, 2, ["a", "b"])
    assert np.allclose(got.loadings, want.loadings) and np.allclose(got.variances, want.variances)


def plain_boosting(x, y, classes, rounds, depth, rate):
    """The same booster row by row."""
    n, d = x.shape
    edges = [(v[:-1] + v[1:]) / 2 for v in (np.unique(x[:, f]) for f in range(d))]
    score = np.tile(np.log(np.bincount(y, minlength=classes) / n), (n, 1))

    def grow(rows, g, level):
        best = None
        total = g[rows].sum()
        if level < depth:
            for f in range(d):
                for t in edges[f]:
                    left = rows[x[rows, f] <= t]
                    if 0 < len(left) < len(rows):
                        a, m = g[left].sum(), len(left)
                        gain = a * a / m + (total - a) ** 2 / (len(rows) - m) - total**2 / len(rows)
                        if best is None and gain > 1e-11 or best is not None and gain > best[0] * (1 + 1e-9) + 1e-12:
                            best = (gain, f, t)
        if best is None:
            curve = np.abs(g[rows]) * (1 - np.abs(g[rows]))
            return {r: (classes - 1) / classes * total / curve.sum() for r in rows}
        low = x[rows, best[1]] <= best[2]
        return {**grow(rows[low], g, level + 1), **grow(rows[~low], g, level + 1)}

    for _ in range(rounds):
        e = np.exp(score - score.max(axis=1, keepdims=True))
        chance = e / e.sum(axis=1, keepdims=True)
        step = np.zeros_like(score)
        for k in range(classes):
            for r, v in grow(np.arange(n), (y == k) - chance[:, k], 0).items():
                step[r, k] = rate * v
        score = score + step
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_boosting_of_classes_equals_a_plain_booster(spark, monkeypatch):
    monkeypatch.setattr(boosting, "FAN_IN", 2)
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 9, 150), rng.integers(0, 5, 150)]).astype(float)
    y = np.clip((x[:, 0] + 2 * x[:, 1] + rng.normal(0, 1.5, 150)) // 5, 0, 2).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), "abc"[k]) for i, (r, k) in enumerate(zip(x, y))], "id int, u double, v double, y string").repartition(5)
    model = learners.fit(df, ["u", "v"], "y", "gradient_boosting_classifier", trees=6, max_depth=2)
    loaded = learners.load_model(learners.save_model(model, scratch_path(spark, "model")))
    rows = {r["id"]: r for r in learners.predict_batch(loaded, df, ["u", "v"], probabilities=True).collect()}
    want = plain_boosting(x, y, 3, 6, 2, 0.1)
    assert np.allclose([rows[i]["probabilities"] for i in range(150)], want, atol=1e-9)
    assert [rows[i]["prediction"] for i in range(150)] == ["abc"[k] for k in want.argmax(axis=1)]
    found = {r["feature"]: r["importance"] for r in learners.feature_importance(model, ["u", "v"], spark).collect()}
    assert sum(found.values()) == pytest.approx(1) and min(found.values()) > 0.05


@pytest.mark.parametrize("target", ["two", "kind"])
def test_probabilities_of_support_vector_machines(spark, grown, target):
    model = learners.fit(grown, FEATURES, target, "svc", max_iter=10)
    loaded = learners.load_model(learners.save_model(model, scratch_path(spark, "model")))
    rows = learners.predict_batch(loaded, grown, FEATURES, probabilities=True).collect()
    classes = 2 if target == "two" else 3
    assert all(len(r["probabilities"]) == classes and abs(sum(r["probabilities"]) - 1) < 1e-9 and r["confidence"] == max(r["probabilities"]) for r in rows)
    sure = [r for r in rows if r["confidence"] > 0.8]
    assert len(sure) > 20 and sum(r["prediction"] == r[target] for r in sure) > 0.8 * len(sure)
    margins = learners.predict_batch(learners.fit(grown, FEATURES, target, "svc", max_iter=5, probability=False), grown, FEATURES)
    assert margins.agg(F.max("confidence")).first()[0] > 0


def test_sigmoid_is_the_likeliest_curve(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(0, 2, 400)
    hit = rng.random(400) < 1 / (1 + np.exp(-(1.3 * m - 0.4)))
    slope, shift = sigmoid.fit_sigmoid(spark.createDataFrame([(float(a), bool(b)) for a, b in zip(m, hit)], "margin double, hit boolean"))
    t = np.where(hit, (hit.sum() + 1) / (hit.sum() + 2), 1 / ((~hit).sum() + 2))
    p = 1 / (1 + np.exp(-(slope * m + shift)))
    assert abs((t - p).sum()) < 1e-6 and abs((m * (t - p)).sum()) < 1e-6
    apart = spark.createDataFrame([(float(i), i > 0) for i in range(-5, 6)], "margin double, hit boolean")
    steep = sigmoid.fit_sigmoid(apart)
    assert 0 < steep[0] < 50
    one = spark.createDataFrame([(float(i), True) for i in range(5)], "margin double, hit boolean")
    assert all(np.isfinite(sigmoid.fit_sigmoid(one)))

"""Components, neighbours, learners, metrics and attributions."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from ..functions.text import words
from ..modeling import learners, sigmoid, training
from ..operators import evaluate, explain, neighbors, reduce, trees
from ..operators.sampling import train_test_split, train_test_split_stratified
from ..session import scratch_path, spread
from ..sources import table
from .inputs import rounded
from .registry import query
from .sampling import H_ORDER

PAIR = """m AS (SELECT avg(l_quantity) AS mx, avg(l_discount * 100) AS my, var_samp(l_quantity) AS a, covar_samp(l_quantity, l_discount * 100) AS b, var_samp(l_discount * 100) AS c FROM lineitem),
  e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS l2 FROM m),
  v AS (SELECT *, (l1 - c) / sqrt(pow(l1 - c, 2) + b * b) AS vx, b / sqrt(pow(l1 - c, 2) + b * b) AS vy FROM e)"""


def _pair(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", (F.col("l_discount") * 100).alias("percent"))


@query(
    "pca",
    f"""WITH {PAIR} SELECT l_orderkey, round((l_quantity - mx) * vx + (l_discount * 100 - my) * vy, 4) AS "PC1",
    round((l_quantity - mx) * -vy + (l_discount * 100 - my) * vx, 4) AS "PC2" FROM lineitem, v""",
)
def pca_query(spark, sf):
    return rounded(reduce.pca(_pair(spark, sf), 2, ["l_quantity", "percent"]), "PC1", "PC2", places=4)


@query(
    "pca_whiten",
    f"""WITH {PAIR} SELECT l_orderkey, round(((l_quantity - mx) * vx + (l_discount * 100 - my) * vy) / sqrt(l1), 4) AS "PC1",
    round(((l_quantity - mx) * -vy + (l_discount * 100 - my) * vx) / sqrt(l2), 4) AS "PC2" FROM lineitem, v""",
)
def whiten_query(spark, sf):
    return rounded(reduce.pca(_pair(spark, sf), 2, ["l_quantity", "percent"], whiten=True), "PC1", "PC2", places=4)


@query(
    "pca_report",
    f"""WITH {PAIR} SELECT 'PC1' AS component, round(l1, 6) AS explained_variance, round(l1 / (l1 + l2), 6) AS ratio, round(l1 / (l1 + l2), 6) AS cumulative FROM v
    UNION ALL SELECT 'PC2', round(l2, 6), round(l2 / (l1 + l2), 6), 1.0 FROM v""",
)
def pca_report_query(spark, sf):
    return rounded(reduce.fit_pca(_pair(spark, sf), 2, ["l_quantity", "percent"]).report(spark), "explained_variance", "ratio", "cumulative")


@query(
    "pca_incremental",
    f"""WITH {PAIR} SELECT l_orderkey, round((l_quantity - mx) * vx + (l_discount * 100 - my) * vy, 4) AS "PC1",
    round((l_quantity - mx) * -vy + (l_discount * 100 - my) * vx, 4) AS "PC2" FROM lineitem, v""",
)
def pca_incremental_query(spark, sf):
    """The table arrives in three parts; each is read once and taken into what is stored of the ones before."""
    rows, columns = _pair(spark, sf), ["l_quantity", "percent"]
    stored = reduce.StoredScatter(spark, scratch_path(spark, "scatter"))
    for part in range(3):
        held = stored.take(rows.filter(F.col("l_orderkey") % 3 == part), columns)
    return rounded(reduce.apply_pca(rows, held.components(2)), "PC1", "PC2", places=4)


@query("pca_embeddings")
def pca_embeddings_query(spark, sf):
    return reduce.pca(table(spark, sf, "embeddings"), 8, "embedding")


# With as many components as dimensions the centred rows are only turned, so their lengths stay.
@query(
    "pca_embeddings_lengths",
    """WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    m AS (SELECT i, avg(x) AS m FROM c GROUP BY 1) SELECT vec_id, round(sum(pow(x - m, 2)), 4) AS squared_length FROM c JOIN m USING (i) GROUP BY 1""",
)
def pca_lengths_query(spark, sf):
    rows = table(spark, sf, "embeddings")
    size = len(rows.select("embedding").first()[0])
    turned = reduce.pca(rows, size, "embedding")
    squares = sum((F.col(f"PC{i + 1}") * F.col(f"PC{i + 1}") for i in range(size)), F.lit(0.0))
    return turned.select("vec_id", F.round(squares, 4).alias("squared_length"))


ALL_PAIRS = """d AS (SELECT a.vec_id AS id, b.vec_id AS other, b.label, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding),
    lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
  n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS r FROM d QUALIFY r <= 5)"""


@query(
    "fit_knn_clf",
    f"""WITH {ALL_PAIRS}, c AS (SELECT id, label, count(*) AS votes FROM n GROUP BY 1, 2)
    SELECT id AS vec_id, arg_min(label, votes * -1000 + label) AS prediction, round(max(votes) / 5, 6) AS confidence FROM c GROUP BY 1""",
)
def knn_classify_query(spark, sf):
    rows = table(spark, sf, "embeddings")
    return rounded(neighbors.knn_classify(rows, rows, "vec_id", "embedding", "label", exclude_self=True), "confidence")


@query("fit_knn_reg", f"WITH {ALL_PAIRS} SELECT id AS vec_id, round(avg(label), 6) AS prediction FROM n GROUP BY 1")
def knn_regress_query(spark, sf):
    rows = table(spark, sf, "embeddings")
    return rounded(neighbors.knn_regress(rows, rows, "vec_id", "embedding", "label", exclude_self=True), "prediction")


TEXT_FEATURES = ["n_chars", "n_words", "mean_word", "distinct_share"]


def labelled_texts(spark, sf, labels=None):
    """The labels, or `labels` made of them, with simple measures of their texts; other texts are not measured."""
    labels = table(spark, sf, "labels") if labels is None else labels
    texts = spread(table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), "text"))
    docs = labels.join(texts, "doc_id").withColumn("w", words(F.col("text")))
    count = F.greatest(F.size("w"), F.lit(1))
    return docs.select(
        *labels.columns,
        "n_chars",
        F.size("w").cast("double").alias("n_words"),
        (F.length(F.array_join("w", "")) / count).alias("mean_word"),
        (F.size(F.array_distinct("w")) / count).alias("distinct_share"),
    )


def _fitted(data, features, target, algorithm, **params):
    """Fit on a cached table; the cache does not outlive the fit."""
    cached = data.persist()
    try:
        return learners.fit(cached, features, target, algorithm, **params)
    finally:
        cached.unpersist()


@query("smote")
def smote_query(spark, sf):
    rows = labelled_texts(spark, sf).select("doc_id", "toxic", F.array(*TEXT_FEATURES).alias("x"))
    return neighbors.smote(rows, "doc_id", "x", "toxic")


@query(
    "smote_classes",
    """WITH n AS (SELECT toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)
    SELECT toxic, (SELECT max(n) FROM n) - n AS added FROM n WHERE n < (SELECT max(n) FROM n)""",
)
def smote_classes_query(spark, sf):
    return smote_query(spark, sf).groupBy("toxic").agg(F.count("*").alias("added"))


def _signs(column: str) -> str:
    """The four signs of classes in a numeric column; two of them are enough."""
    return f"""SELECT '{column}' AS "column", CASE WHEN (u <= 10)::INT + (u <= greatest(2, n * 0.05))::INT + (whole AND u <= 20)::INT + (whole AND lo >= 0 AND hi <= 1)::INT >= 2
      THEN 'classification' ELSE 'regression' END AS problem_type
      FROM (SELECT count(DISTINCT {column}) AS u, count({column}) AS n, bool_and({column} = floor({column})) AS whole, min({column}) AS lo, max({column}) AS hi FROM lineitem)"""


@query(
    "detect_problem_type",
    "SELECT 'l_returnflag' AS \"column\", 'classification' AS problem_type UNION ALL "
    + " UNION ALL ".join(_signs(c) for c in ("l_linenumber", "l_extendedprice", "l_partkey", "l_tax")),
)
def problem_query(spark, sf):
    lines = table(spark, sf, "lineitem")
    names = ["l_returnflag", "l_linenumber", "l_extendedprice", "l_partkey", "l_tax"]
    return spark.createDataFrame([(c, evaluate.detect_problem_type(lines, c)) for c in names], "column string, problem_type string")


def _classifier(algorithm, **params):
    def run(spark, sf):
        data = labelled_texts(spark, sf)
        model = _fitted(data, TEXT_FEATURES, "quality", algorithm, **params)
        return learners.predict_batch(model, data, TEXT_FEATURES).select("doc_id", "quality", "prediction", "confidence")

    return run


def part_rows(spark, sf):
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("double")
    return spread(table(spark, sf, "part")).select("p_partkey", F.col("p_size").cast("double").alias("size"), brand.alias("brand"), "p_retailprice")


PART_FEATURES = ["size", "brand"]


def _regressor(algorithm, **params):
    def run(spark, sf):
        data = part_rows(spark, sf)
        model = _fitted(data, PART_FEATURES, "p_retailprice", algorithm, **params)
        return learners.predict_batch(model, data, PART_FEATURES).select("p_partkey", "p_retailprice", "prediction")

    return run


query("fit_logistic_regression")(_classifier("logistic_regression"))
query("fit_random_forest_clf")(_classifier("random_forest_classifier"))
query("fit_gradient_boosting_clf")(_classifier("gradient_boosting_classifier"))
query("fit_decision_tree_clf")(_classifier("decision_tree_classifier"))
query("fit_svc")(_classifier("svc"))
query("fit_random_forest_reg")(_regressor("random_forest_regressor"))
query("fit_gradient_boosting_reg")(_regressor("gradient_boosting_regressor"))
query("fit_decision_tree_reg")(_regressor("decision_tree_regressor"))
query("fit_svr")(_regressor("svr"))


def _stump(number: int, source: str, value: str) -> str:
    """The split of `brand` with the least squared error, and the means of its sides."""
    n = number
    return f"""s{n} AS (SELECT t.brand AS t, sum(pow({value}, 2)) FILTER (WHERE r.brand <= t.brand) - pow(sum({value}) FILTER (WHERE r.brand <= t.brand), 2) / count(*) FILTER (WHERE r.brand <= t.brand)
      + sum(pow({value}, 2)) FILTER (WHERE r.brand > t.brand) - pow(sum({value}) FILTER (WHERE r.brand > t.brand), 2) / count(*) FILTER (WHERE r.brand > t.brand) AS e,
      avg({value}) FILTER (WHERE r.brand <= t.brand) AS low, avg({value}) FILTER (WHERE r.brand > t.brand) AS high
      FROM (SELECT DISTINCT brand FROM {source}) t, {source} r GROUP BY 1),
    b{n} AS (SELECT * FROM s{n} WHERE e IS NOT NULL ORDER BY e LIMIT 1)"""


BRANDS = "r0 AS (SELECT p_partkey, p_retailprice AS y, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS DOUBLE) AS brand FROM part)"
FIRST = f"{BRANDS}, {_stump(1, 'r0', 'y')}, r1 AS (SELECT r0.*, CASE WHEN brand <= t THEN low ELSE high END AS f FROM r0, b1)"


def _stumps(algorithm, **params):
    def run(spark, sf):
        data = part_rows(spark, sf)
        model = _fitted(data, ["brand"], "p_retailprice", algorithm, max_depth=1, **params)
        return rounded(learners.predict_batch(model, data, ["brand"]).select("p_partkey", "prediction"), "prediction", places=4)

    return run


# Trees of one split, and boosting by two of them, can be found in SQL.
query("fit_decision_tree_reg_stump", f"WITH {FIRST} SELECT p_partkey, round(f, 4) AS prediction FROM r1")(_stumps("decision_tree_regressor"))
query(
    "fit_gradient_boosting_reg_stumps",
    f"""WITH {FIRST}, {_stump(2, 'r1', '(2 * (y - f))')}
    SELECT p_partkey, round(f + 0.1 * CASE WHEN brand <= t THEN low ELSE high END, 4) AS prediction FROM r1, b2""",
)(_stumps("gradient_boosting_regressor", trees=2))


def _softmax_round(number: int, source: str) -> str:
    """A stump for each of three classes on the gradients of the softmax: cells are months with `c` rows, `y0..y2` of each class and scores `f0..f2`."""
    n = number
    steps = [
        f"""p{n} AS (SELECT *, exp(f0) + exp(f1) + exp(f2) AS z FROM {source}),
        g{n} AS (SELECT month, c, f0, f1, f2, y0, y1, y2, {', '.join(f'exp(f{k}) / z AS q{k}' for k in range(3))} FROM p{n}),
        h{n} AS (SELECT *, {', '.join(f'y{k} - c * q{k} AS r{k}, c * q{k} * (1 - q{k}) AS v{k}' for k in range(3))} FROM g{n})"""
    ]
    for k in range(3):
        low, high = "FILTER (WHERE h.month <= t.month)", "FILTER (WHERE h.month > t.month)"
        steps.append(
            f"""s{n}{k} AS (SELECT t.month AS t, pow(sum(r{k}) {low}, 2) / sum(c) {low} + pow(sum(r{k}) {high}, 2) / sum(c) {high} AS gain,
              2.0 / 3 * sum(r{k}) {low} / sum(v{k}) {low} AS low, 2.0 / 3 * sum(r{k}) {high} / sum(v{k}) {high} AS high FROM (SELECT DISTINCT month FROM h{n}) t, h{n} h GROUP BY 1),
            b{n}{k} AS (SELECT * FROM s{n}{k} WHERE gain IS NOT NULL ORDER BY gain DESC, t LIMIT 1)"""
        )
    moved = ", ".join(f"f{k} + 0.1 * CASE WHEN month <= b{n}{k}.t THEN b{n}{k}.low ELSE b{n}{k}.high END AS f{k}" for k in range(3))
    steps.append(f"m{n} AS (SELECT month, c, y0, y1, y2, {moved} FROM h{n}, b{n}0, b{n}1, b{n}2)")
    return ", ".join(steps)


# Where margins take two values, the likeliest curve meets the share of each, with labels drawn in from 0 and 1.
@query(
    "svc_sigmoid",
    """WITH m AS (SELECT CASE WHEN l_quantity > 25 THEN 0.8 ELSE -0.4 END AS margin, l_discount >= 0.06 AS hit FROM lineitem), n AS (SELECT count(*) FILTER (WHERE hit) AS a, count(*) FILTER (WHERE NOT hit) AS b FROM m)
    SELECT margin::DOUBLE AS margin, round(avg(CASE WHEN hit THEN (a + 1) / (a + 2) ELSE 1 / (b + 2) END), 6) AS probability FROM m, n GROUP BY 1""",
)
def sigmoid_query(spark, sf):
    margin = F.when(F.col("l_quantity") > 25, 0.8).otherwise(-0.4)
    rows = table(spark, sf, "lineitem").select(margin.alias("margin"), (F.col("l_discount") >= 0.06).alias("hit"))
    slope, shift = sigmoid.fit_sigmoid(rows)
    curve = 1 / (1 + F.exp(-(F.lit(slope) * F.col("margin") + F.lit(shift))))
    return rounded(rows.select("margin").distinct().withColumn("probability", curve), "probability")


# Two rounds of boosting by stumps for three classes, from counts by month.
@query(
    "fit_gradient_boosting_classes",
    f"""WITH cells AS (SELECT month(o_orderdate) AS month, count(*)::DOUBLE AS c, {', '.join(f"count(*) FILTER (WHERE o_orderstatus = '{s}')::DOUBLE AS y{k}" for k, s in enumerate("FOP"))} FROM orders GROUP BY 1),
    t AS (SELECT {', '.join(f'ln(sum(y{k}) / sum(c)) AS f{k}' for k in range(3))} FROM cells), m0 AS (SELECT cells.*, f0, f1, f2 FROM cells, t), {_softmax_round(1, 'm0')}, {_softmax_round(2, 'm1')}
    SELECT month, {', '.join(f'round(exp(f{k}) / (exp(f0) + exp(f1) + exp(f2)), 6) AS p{k}' for k in range(3))} FROM m2""",
)
def boosted_classes_query(spark, sf):
    data = table(spark, sf, "orders").select(F.month("o_orderdate").cast("int").alias("month"), "o_orderstatus")
    model = _fitted(data, ["month"], "o_orderstatus", "gradient_boosting_classifier", trees=2, max_depth=1)
    scored = learners.predict_batch(model, data.select("month").distinct(), ["month"], probabilities=True)
    return rounded(scored.select("month", *[F.col("probabilities")[k].alias(f"p{k}") for k in range(3)]), "p0", "p1", "p2")


# With one yes-or-no feature and hardly any penalty the probabilities are the shares of its two groups.
@query(
    "fit_logistic_regression_shares",
    "SELECT toxic, round(avg(quality), 3) AS share FROM labels GROUP BY 1",
)
def logistic_shares_query(spark, sf):
    data = table(spark, sf, "labels")
    model = _fitted(data, ["toxic"], "quality", "logistic_regression", C=1e6)
    scored = learners.predict_batch(model, data, ["toxic"], probabilities=True)
    return rounded(scored.groupBy("toxic").agg(F.avg(F.element_at("probabilities", -1)).alias("share")), "share", places=3)


def _line(spark, sf, feature, target, algorithm, **params):
    data = table(spark, sf, "lineitem").select(feature, target)
    learner = learners.learner_of(learners.fit(data, [feature], target, algorithm, **params))
    return spark.createDataFrame(
        [(feature, round(float(learner.coefficients[0]), 4), round(float(learner.intercept), 4))], "feature string, coefficient double, intercept double"
    )


@query(
    "fit_linear_regression",
    "SELECT 'l_discount' AS feature, round(regr_slope(l_quantity, l_discount), 4) AS coefficient, round(regr_intercept(l_quantity, l_discount), 4) AS intercept FROM lineitem",
)
def linear_query(spark, sf):
    return _line(spark, sf, "l_discount", "l_quantity", "linear_regression")


@query(
    "fit_ridge",
    """WITH s AS (SELECT regr_sxy(l_quantity, l_discount) / (regr_sxx(l_quantity, l_discount) + 1) AS k, avg(l_quantity) AS my, avg(l_discount) AS mx FROM lineitem)
    SELECT 'l_discount' AS feature, round(k, 4) AS coefficient, round(my - k * mx, 4) AS intercept FROM s""",
)
def ridge_query(spark, sf):
    return _line(spark, sf, "l_discount", "l_quantity", "ridge_regression")


@query(
    "fit_lasso",
    """WITH s AS (SELECT (covar_pop(l_extendedprice, l_quantity) - 1) / var_pop(l_quantity) AS k, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem)
    SELECT 'l_quantity' AS feature, round(k, 2) AS coefficient, round(my - k * mx, 2) AS intercept FROM s""",
)
def lasso_query(spark, sf):
    return rounded(_line(spark, sf, "l_quantity", "l_extendedprice", "lasso_regression"), "coefficient", "intercept", places=2)


@query(
    "cross_validate_line",
    f"""WITH o AS (SELECT o_custkey AS x, o_totalprice / 1000 AS y, CAST({H_ORDER} % 5 AS INTEGER) AS fold FROM orders),
    m AS (SELECT i.fold, regr_slope(y, x) AS k, regr_intercept(y, x) AS b FROM o JOIN (SELECT DISTINCT fold FROM o) i ON o.fold <> i.fold GROUP BY 1),
    a AS (SELECT fold, avg(y) AS my FROM o GROUP BY 1),
    s AS (SELECT fold, 1 - sum(pow(y - b - k * x, 2)) / sum(pow(y - my, 2)) AS r2 FROM o JOIN m USING (fold) JOIN a USING (fold) GROUP BY 1)
    SELECT 'fold_' || fold AS score, round(r2, 6) AS value FROM s UNION ALL SELECT 'mean', round(avg(r2), 6) FROM s UNION ALL SELECT 'std', round(stddev_pop(r2), 6) FROM s""",
)
def cross_validate_line_query(spark, sf):
    data = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("price"))
    found = training.cross_validate(data, ["o_custkey"], "price", "linear_regression", "o_orderkey", 5)
    rows = [(f"fold_{i}", float(s)) for i, s in enumerate(found["scores"])]
    rows += [("mean", float(found["mean_score"])), ("std", float(found["std_score"]))]
    return rounded(spark.createDataFrame(rows, "score string, value double"), "value")


@query("cross_validate")
def cross_validate_query(spark, sf):
    found = training.cross_validate(labelled_texts(spark, sf), TEXT_FEATURES, "quality", "logistic_regression", "doc_id", 5)
    rows = [(f"fold_{i}", float(s)) for i, s in enumerate(found["scores"])]
    rows += [("mean", float(found["mean_score"])), ("std", float(found["std_score"]))]
    return spark.createDataFrame(rows, "score string, value double")


def _trials(spark, found):
    rows = [(str(sorted(t["params"].items())), float(t["score"]), t["params"] == found["params"]) for t in found["trials"]]
    return spark.createDataFrame(rows, "params string, score double, chosen boolean")


@query("tune_grid")
def tune_grid_query(spark, sf):
    data = labelled_texts(spark, sf)
    return _trials(spark, training.tune_grid(data, TEXT_FEATURES, "toxic", "logistic_regression", "doc_id", folds=3))


ALPHAS = [1.0, 1000.0, 100000.0]


def _priced(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") / 1000).alias("customer"), (F.col("o_totalprice") / 1000).alias("price"))


# Ridge regression on one feature in closed form: the score of every penalty on every fold.
RIDGE_FOLDS = f"""o AS (SELECT o_custkey / 1000 AS x, o_totalprice / 1000 AS y, {H_ORDER} % 5 AS f5, {H_ORDER} % 3 AS f3, {H_ORDER} % 1000000 < 200000 AS is_test FROM orders)"""


def _ridge_scores(rows: str, fold: str) -> str:
    return f"""i AS (SELECT DISTINCT {fold} AS fold FROM {rows}), s AS (SELECT fold, regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx, avg(x) AS mx, avg(y) AS my FROM {rows} JOIN i ON {fold} <> fold GROUP BY 1),
    k AS (SELECT fold, alpha, sxy / (sxx + alpha) AS k, my - sxy / (sxx + alpha) * mx AS b FROM s, p), a AS (SELECT {fold} AS fold, avg(y) AS m FROM {rows} GROUP BY 1),
    r AS (SELECT fold, alpha, 1 - sum(pow(y - b - k * x, 2)) / sum(pow(y - m, 2)) AS r2 FROM {rows} JOIN k ON {fold} = fold JOIN a USING (fold) GROUP BY 1, 2)"""


@query(
    "tune_grid_ridge",
    f"""WITH {RIDGE_FOLDS}, p AS (SELECT unnest([1.0, 1000.0, 100000.0])::DOUBLE AS alpha), {_ridge_scores('o', 'f3')}, g AS (SELECT alpha, avg(r2) AS score FROM r GROUP BY 1)
    SELECT alpha, round(score, 6) AS score, score = (SELECT max(score) FROM g) AS chosen FROM g""",
)
def tune_ridge_query(spark, sf):
    found = training.tune_grid(_priced(spark, sf), ["customer"], "price", "ridge_regression", "o_orderkey", {"alpha": ALPHAS}, 3)
    rows = [(t["params"]["alpha"], float(t["score"]), t["params"] == found["params"]) for t in found["trials"]]
    return rounded(spark.createDataFrame(rows, "alpha double, score double, chosen boolean"), "score")


@query(
    "automl_select_lines",
    f"""WITH {RIDGE_FOLDS}, t AS (SELECT * FROM o WHERE NOT is_test), p AS (SELECT unnest([0.0, 1.0])::DOUBLE AS alpha), {_ridge_scores('t', 'f5')},
    c AS (SELECT alpha, avg(r2) AS cv, stddev_pop(r2) AS sd FROM r GROUP BY 1),
    w AS (SELECT alpha, regr_sxy(y, x) / (regr_sxx(y, x) + alpha) AS k, avg(x) AS mx, avg(y) AS my FROM t, p GROUP BY 1), e AS (SELECT avg(y) AS m FROM o WHERE is_test),
    f AS (SELECT alpha, 1 - sum(pow(y - my - k * (x - mx), 2)) / sum(pow(y - m, 2)) AS r2 FROM o, w, e WHERE is_test GROUP BY 1)
    SELECT CASE alpha WHEN 0 THEN 'linear_regression' ELSE 'ridge_regression' END AS algorithm, round(cv, 6) AS cv_score, round(sd, 6) AS cv_std, round(f.r2, 6) AS r2_score,
      cv = (SELECT max(cv) FROM c) AS best FROM c JOIN f USING (alpha)""",
)
def automl_lines_query(spark, sf):
    found = training.automl_select(_priced(spark, sf), ["customer"], "price", "o_orderkey", ["linear", "ridge"], "regression")
    rows = [(e["algorithm"], e["cv_score"], e["cv_std"], e["r2_score"], e["algorithm"] == found["best"]["algorithm"]) for e in found["leaderboard"]]
    return rounded(spark.createDataFrame(rows, "algorithm string, cv_score double, cv_std double, r2_score double, best boolean"), "cv_score", "cv_std", "r2_score")


PENALTIES = [0.01, 1_000_000.0]


def _drawn(count: int) -> list[float]:
    """Penalties as a seeded search draws them, evenly by their logarithm."""
    rng = random.Random(42)
    return [math.exp(rng.uniform(math.log(PENALTIES[0]), math.log(PENALTIES[1]))) for _ in range(count)]


@query(
    "tune_random",
    f"""WITH {RIDGE_FOLDS}, p AS (SELECT unnest({_drawn(50)})::DOUBLE AS alpha), {_ridge_scores('o', 'f3')}, g AS (SELECT alpha, avg(r2) AS score FROM r GROUP BY 1)
    SELECT round(alpha, 6) AS alpha, round(score, 6) AS score FROM g""",
)
def tune_random_query(spark, sf):
    found = training.tune_random(_priced(spark, sf), ["customer"], "price", "ridge_regression", "o_orderkey", grid={"alpha": PENALTIES})
    rows = [(t["params"]["alpha"], float(t["score"])) for t in found["trials"]]
    return rounded(spark.createDataFrame(rows, "alpha double, score double"), "alpha", "score")


# What the search should come near: the best penalty of a fine grid over the whole range.
@query(
    "tune_parzen",
    f"""WITH {RIDGE_FOLDS}, p AS (SELECT pow(10, -2 + 8.0 * i / 2000) AS alpha FROM range(0, 2001) t(i)), {_ridge_scores('o', 'f3')}, g AS (SELECT alpha, avg(r2) AS score FROM r GROUP BY 1)
    SELECT 50 AS trials, 0 AS not_run, round(max(score), 5) AS score FROM g""",
)
def tune_parzen_query(spark, sf):
    found = training.tune_parzen(_priced(spark, sf), ["customer"], "price", "ridge_regression", "o_orderkey", grid={"alpha": PENALTIES})
    row = (len(found["trials"]), found["not_run"], float(found["score"]))
    return rounded(spark.createDataFrame([row], "trials int, not_run int, score double"), "score", places=5)


@query("automl_select")
def automl_query(spark, sf):
    found = training.automl_select(part_rows(spark, sf), PART_FEATURES, "p_retailprice", "p_partkey")
    best = found["best"]["algorithm"]
    rows = [(e["algorithm"], e["status"], e.get("cv_score"), e.get("r2_score"), e["algorithm"] == best) for e in found["leaderboard"]]
    return spark.createDataFrame(rows, "algorithm string, status string, cv_score double, r2_score double, best boolean")


BINARY = "p AS (SELECT quality AS y, toxic AS p FROM labels)"


@query(
    "eval_accuracy_prf",
    f"""WITH {BINARY}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = p) AS ok, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp,
      count(*) FILTER (WHERE p = 1) AS said, count(*) FILTER (WHERE y = 1) AS real FROM p)
    SELECT 'accuracy' AS metric, round(ok / n, 6) AS value FROM c UNION ALL SELECT 'precision', round(tp / said, 6) FROM c
    UNION ALL SELECT 'recall', round(tp / real, 6) FROM c UNION ALL SELECT 'f1_score', round(2 * tp / (said + real), 6) FROM c""",
)
def prf_query(spark, sf):
    found = evaluate.classification_metrics(table(spark, sf, "labels"), "quality", "toxic")
    return rounded(evaluate.metric_rows(spark, found), "value")


GUESS = "g AS (SELECT o_orderkey, o_orderstatus AS y, CASE WHEN o_totalprice > 300000 THEN 'F' WHEN o_totalprice > 100000 THEN 'O' ELSE 'X' END AS p, o_totalprice AS s FROM orders)"


def guesses(spark, sf):
    p = F.when(F.col("o_totalprice") > 300000, "F").when(F.col("o_totalprice") > 100000, "O").otherwise("X")
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("y"), p.alias("p"), F.col("o_totalprice").alias("s"))


@query(
    "eval_weighted_prf",
    f"""WITH {GUESS}, k AS (SELECT y AS c FROM g UNION SELECT p FROM g),
    c AS (SELECT k.c, count(*) FILTER (WHERE y = k.c AND p = k.c) AS tp, count(*) FILTER (WHERE p = k.c) AS said, count(*) FILTER (WHERE y = k.c) AS real FROM g, k GROUP BY 1),
    e AS (SELECT *, CASE WHEN said = 0 THEN 0 ELSE tp / said END AS pr, CASE WHEN real = 0 THEN 0 ELSE tp / real END AS re FROM c),
    f AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM e)
    SELECT 'accuracy' AS metric, round(sum(tp) / sum(real), 6) AS value FROM f UNION ALL SELECT 'precision', round(sum(pr * real) / sum(real), 6) FROM f
    UNION ALL SELECT 'recall', round(sum(re * real) / sum(real), 6) FROM f UNION ALL SELECT 'f1_score', round(sum(f1 * real) / sum(real), 6) FROM f""",
)
def weighted_query(spark, sf):
    return rounded(evaluate.metric_rows(spark, evaluate.classification_metrics(guesses(spark, sf), "y", "p")), "value")


@query(
    "confusion_matrix",
    f"""WITH {GUESS}, k AS (SELECT y AS c FROM g UNION SELECT p FROM g), n AS (SELECT y, p, count(*) AS n FROM g GROUP BY 1, 2)
    SELECT a.c AS label, b.c AS prediction, coalesce(n, 0) AS n FROM k a, k b LEFT JOIN n ON n.y = a.c AND n.p = b.c""",
)
def confusion_query(spark, sf):
    return evaluate.confusion_matrix(guesses(spark, sf), "y", "p")


def _auc(c: str) -> str:
    return f"""(SELECT (sum(r) FILTER (WHERE y = '{c}') - count(*) FILTER (WHERE y = '{c}') * (count(*) FILTER (WHERE y = '{c}') + 1) / 2)
      / (CAST(count(*) FILTER (WHERE y = '{c}') AS DOUBLE) * count(*) FILTER (WHERE y <> '{c}')) FROM r)"""


RANKED = f"{GUESS}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM g)"


@query("roc_auc", f"WITH {RANKED} SELECT 'F' AS positive, round({_auc('F')}, 6) AS auc")
def auc_query(spark, sf):
    value = evaluate.roc_auc(guesses(spark, sf), "y", "s", "F")
    return rounded(spark.createDataFrame([("F", value)], "positive string, auc double"), "auc")


@query(
    "roc_auc_multiclass",
    f"""WITH {RANKED}, a AS (SELECT 'F' AS class, {_auc('F')} AS auc UNION ALL SELECT 'O', {_auc('O')} UNION ALL SELECT 'P', {_auc('P')})
    SELECT class, round(auc, 6) AS auc FROM a UNION ALL SELECT '*', round(avg(auc), 6) FROM a""",
)
def auc_multi_query(spark, sf):
    return rounded(evaluate.roc_auc_multiclass(guesses(spark, sf), "y", {"F": "s", "O": "s", "P": "s"}), "auc")


@query(
    "eval_regression",
    """WITH p AS (SELECT l_quantity AS y, l_extendedprice / 1500 AS p FROM lineitem), e AS (SELECT y, y - p AS e FROM p),
    m AS (SELECT avg(e * e) AS mse, avg(abs(e)) AS mae, median(abs(e)) AS med, var_pop(y) AS vy, var_pop(e) AS ve FROM e)
    SELECT 'mse' AS metric, round(mse, 6) AS value FROM m UNION ALL SELECT 'rmse', round(sqrt(mse), 6) FROM m UNION ALL SELECT 'r2_score', round(1 - mse / vy, 6) FROM m
    UNION ALL SELECT 'mae', round(mae, 6) FROM m UNION ALL SELECT 'median_absolute_error', round(med, 6) FROM m UNION ALL SELECT 'explained_variance', round(1 - ve / vy, 6) FROM m""",
)
def regression_query(spark, sf):
    pairs = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1500).alias("p"))
    return rounded(evaluate.metric_rows(spark, evaluate.regression_metrics(pairs, "l_quantity", "p")), "value")


@query("predict_batch")
def predict_query(spark, sf):
    data = labelled_texts(spark, sf, train_test_split_stratified(table(spark, sf, "labels"), "quality", "doc_id"))
    model = _fitted(data.filter(~F.col("is_test")), TEXT_FEATURES, "quality", "logistic_regression")
    return learners.predict_batch(model, data.filter("is_test"), TEXT_FEATURES).select("doc_id", "prediction", "confidence")


@query(
    "predict_batch_line",
    f"""WITH {RIDGE_FOLDS.replace('o_custkey / 1000 AS x', 'o_orderkey, o_custkey / 1000 AS x')}, t AS (SELECT regr_slope(y, x) AS k, regr_intercept(y, x) AS b FROM o WHERE NOT is_test)
    SELECT o_orderkey, round(b + k * x, 6) AS prediction FROM o, t WHERE is_test""",
)
def predict_line_query(spark, sf):
    data = train_test_split(_priced(spark, sf), "o_orderkey")
    model = _fitted(data.filter(~F.col("is_test")), ["customer"], "price", "linear_regression")
    return rounded(learners.predict_batch(model, data.filter("is_test"), ["customer"]).select("o_orderkey", "prediction"), "prediction")


@query(
    "save_load_model",
    """WITH t AS (SELECT regr_slope(o_totalprice / 1000, o_custkey) AS w, regr_intercept(o_totalprice / 1000, o_custkey) AS b FROM orders)
    SELECT o_orderkey, round(b + w * o_custkey, 6) AS prediction FROM orders, t""",
)
def save_load_query(spark, sf):
    data = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("price"))
    model = learners.fit(data, ["o_custkey"], "price", "linear_regression")
    loaded = learners.load_model(learners.save_model(model, scratch_path(spark, "model")))
    return rounded(learners.predict_batch(loaded, data, ["o_custkey"]).select("o_orderkey", "prediction"), "prediction")


@query("feature_importance_tree")
def tree_importance_query(spark, sf):
    model = learners.fit(labelled_texts(spark, sf), TEXT_FEATURES, "quality", "decision_tree_classifier")
    return learners.feature_importance(model, TEXT_FEATURES, spark)


# Ordinary least squares on two features in closed form.
PLANE = """s AS (SELECT covar_pop(l_quantity, l_discount) AS c1, covar_pop(l_quantity, l_tax) AS c2, var_pop(l_discount) AS a, covar_pop(l_discount, l_tax) AS b,
  var_pop(l_tax) AS c, avg(l_discount) AS m1, avg(l_tax) AS m2 FROM lineitem),
  k AS (SELECT m1, m2, (c1 * c - c2 * b) / (a * c - b * b) AS w1, (c2 * a - c1 * b) / (a * c - b * b) AS w2 FROM s)"""
PLANE_FEATURES = ["l_discount", "l_tax"]


def _plane(spark, sf):
    data = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", *PLANE_FEATURES)
    return data, learners.fit(data, PLANE_FEATURES, "l_quantity", "linear_regression")


@query(
    "feature_importance",
    f"WITH {PLANE} SELECT 'l_discount' AS feature, round(abs(w1), 6) AS importance FROM k UNION ALL SELECT 'l_tax', round(abs(w2), 6) FROM k",
)
def importance_query(spark, sf):
    _, model = _plane(spark, sf)
    return rounded(learners.feature_importance(model, PLANE_FEATURES, spark), "importance")


def _locals(value: str) -> str:
    return " UNION ALL ".join(
        f"SELECT l_partkey, '{f}' AS feature, {value.format(x=f, w=w, m=m)} AS v FROM lineitem, k" for f, w, m in (("l_discount", "w1", "m1"), ("l_tax", "w2", "m2"))
    )


@query("shap_linear", f"WITH {PLANE}, x AS ({_locals('({x} - {m}) * {w}')}) SELECT l_partkey, feature, round(v, 6) AS shap FROM x")
def shap_linear_query(spark, sf):
    data, model = _plane(spark, sf)
    weights = dict(zip(PLANE_FEATURES, learners.learner_of(model).coefficients.tolist()))
    return rounded(explain.shap_linear(data, "l_partkey", weights), "shap")


@query(
    "global_importance",
    f"WITH {PLANE}, x AS ({_locals('({x} - {m}) * {w}')}) SELECT feature, round(avg(abs(v)), 6) AS importance, 0.0 AS mean_value FROM x GROUP BY 1",
)
def global_query(spark, sf):
    data, model = _plane(spark, sf)
    weights = dict(zip(PLANE_FEATURES, learners.learner_of(model).coefficients.tolist()))
    df = rounded(explain.global_importance(explain.shap_linear(data, "l_partkey", weights)), "importance", "mean_value")
    return df.withColumn("mean_value", F.abs("mean_value"))


# Least squares on three features by Cramer's rule.
ORDER_FEATURES = ["customer", "weekday", "priority"]
SPACE = """d AS (SELECT o_orderkey, o_custkey / 1000 AS customer, dayofweek(o_orderdate) + 1.0 AS weekday, CAST(left(o_orderpriority, 1) AS DOUBLE) AS priority, o_totalprice / 1000 AS y FROM orders),
  s AS (SELECT var_pop(customer) AS a, covar_pop(customer, weekday) AS b, covar_pop(customer, priority) AS c, var_pop(weekday) AS e, covar_pop(weekday, priority) AS f, var_pop(priority) AS i,
    covar_pop(customer, y) AS u, covar_pop(weekday, y) AS v, covar_pop(priority, y) AS w, avg(customer) AS m1, avg(weekday) AS m2, avg(priority) AS m3 FROM d),
  g AS (SELECT *, a * (e * i - f * f) - b * (b * i - c * f) + c * (b * f - c * e) AS det FROM s),
  k AS (SELECT m1, m2, m3, (u * (e * i - f * f) - b * (v * i - f * w) + c * (v * f - e * w)) / det AS w1, (a * (v * i - w * f) - u * (b * i - c * f) + c * (b * w - c * v)) / det AS w2,
    (a * (e * w - f * v) - b * (b * w - c * v) + u * (b * f - c * e)) / det AS w3 FROM g)"""


def _spaced(value: str, name: str) -> str:
    cells = [f"SELECT o_orderkey, '{f}' AS feature, round({value.format(x=f'({f} - m{n}) * w{n}')}, 6) + 0 AS {name} FROM d, k" for n, f in enumerate(ORDER_FEATURES, 1)]
    return f"WITH {SPACE} " + " UNION ALL ".join(cells)


def _space(spark, sf):
    data = table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") / 1000).alias("customer"),
        F.dayofweek("o_orderdate").cast("double").alias("weekday"),
        F.left("o_orderpriority", F.lit(1)).cast("double").alias("priority"),
        (F.col("o_totalprice") / 1000).alias("price"),
    )
    return data, _fitted(data, ORDER_FEATURES, "price", "linear_regression")


@query("mean_substitution_importance", _spaced("abs({x})", "importance"))
def substitution_query(spark, sf):
    data, model = _space(spark, sf)
    return rounded(explain.mean_substitution_importance(model, data, "o_orderkey", ORDER_FEATURES), "importance")


# With means as background every order gives a linear model its exact attributions.
@query("shap_sampling", _spaced("{x}", "shap"))
def shap_sampling_query(spark, sf):
    data, model = _space(spark, sf)
    return rounded(explain.shap_sampling(model, data, "o_orderkey", ORDER_FEATURES), "shap")


CHARGE_FEATURES = ["bulk", "discount", "tax"]


def _grown(depth: int) -> str:
    """A regression tree of the table `x` (key, f, y) by least squared error: `a<depth>` has the node of each row, `nodes` the splits."""
    steps = ["a0 AS (SELECT *, 1 AS node FROM x)"]
    for d in range(depth):
        steps.append(
            f"""v{d} AS (SELECT node, k, f[k] AS value, count(*) AS n, sum(y) AS s FROM a{d}, range(1, 4) t(k) GROUP BY ALL),
            w{d} AS (SELECT node, k, value + 0.5 AS t, sum(n) OVER u AS n, sum(s) OVER u AS s, sum(n) OVER (PARTITION BY node, k) AS nt, sum(s) OVER (PARTITION BY node, k) AS st
              FROM v{d} WINDOW u AS (PARTITION BY node, k ORDER BY value)),
            b{d} AS (SELECT node, max(nt) AS n, arg_max(k, s * s / n + (st - s) * (st - s) / (nt - n)) AS k, arg_max(t, s * s / n + (st - s) * (st - s) / (nt - n)) AS t FROM w{d} WHERE n < nt GROUP BY node),
            a{d + 1} AS (SELECT key, f, y, 2 * a.node + CASE WHEN f[k] > t THEN 1 ELSE 0 END AS node FROM a{d} a JOIN b{d} b ON a.node = b.node)"""
        )
    steps.append("nodes AS (" + " UNION ALL ".join(f"SELECT * FROM b{d}" for d in range(depth)) + ")")
    return ", ".join(steps)


# All subsets of the features: known ones decide the way, at others a row is shared out as the training rows went.
SUBSETS = f"""x AS (SELECT l_orderkey * 10 + l_linenumber AS key, [floor(l_quantity / 10), round(l_discount * 100), round(l_tax * 100)]::DOUBLE[] AS f, l_extendedprice * l_discount / 1000 AS y FROM lineitem),
  {_grown(3)}, leaves AS (SELECT node, count(*) AS n, avg(y) AS value FROM a3 GROUP BY 1),
  counts AS (SELECT node, n FROM nodes UNION ALL SELECT node, n FROM leaves),
  way AS (SELECT l.node AS leaf, value, p.k, p.t, (l.node >> d) & 1 AS side, c.n / p.n AS share FROM leaves l, range(0, 3) r(d), nodes p, counts c WHERE p.node = l.node >> (d + 1) AND c.node = l.node >> d),
  cells AS (SELECT DISTINCT f FROM x), sets AS (SELECT s FROM range(0, 8) r(s)),
  reached AS (SELECT f, s, leaf, any_value(value) * product(CASE WHEN (s >> (k - 1)) & 1 = 0 THEN share WHEN (f[k] > t) = (side = 1) THEN 1 ELSE 0 END) AS part FROM cells, sets, way GROUP BY 1, 2, 3),
  worth AS (SELECT f, s, sum(part) AS v FROM reached GROUP BY 1, 2),
  phi AS (SELECT a.f, k, sum((b.v - a.v) * CASE WHEN bit_count(a.s) = 1 THEN 1 ELSE 2 END / 6) AS shap FROM worth a JOIN worth b ON a.f = b.f, range(1, 4) t(k)
    WHERE (a.s >> (k - 1)) & 1 = 0 AND b.s = a.s + (1 << (k - 1)) GROUP BY 1, 2)"""


def _charges(spark, sf):
    data = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.floor(F.col("l_quantity") / 10).cast("double").alias("bulk"),
        F.round(F.col("l_discount") * 100).alias("discount"), F.round(F.col("l_tax") * 100).alias("tax"),
        (F.col("l_extendedprice") * F.col("l_discount") / 1000).alias("charge"),
    )
    return data, learners.fit(data, CHARGE_FEATURES, "charge", "decision_tree_regressor", max_depth=3)


@query(
    "shap_tree",
    f"""WITH {SUBSETS} SELECT x.key AS line, ['bulk', 'discount', 'tax'][k] AS feature, round(shap, 6) + 0 AS shap FROM x JOIN phi ON x.f = phi.f""",
)
def shap_exact_query(spark, sf):
    data, model = _charges(spark, sf)
    return rounded(trees.shap_tree(model, data, "line", CHARGE_FEATURES), "shap")


@query(
    "shap_tree_importance",
    f"""WITH {SUBSETS} SELECT ['bulk', 'discount', 'tax'][k] AS feature, round(avg(abs(shap)), 6) AS importance, round(abs(avg(shap)), 6) AS mean_value FROM x JOIN phi ON x.f = phi.f GROUP BY 1""",
)
def shap_importance_query(spark, sf):
    data, model = _charges(spark, sf)
    found = rounded(trees.shap_tree_importance(model, data, "line", CHARGE_FEATURES), "importance", "mean_value")
    return found.withColumn("mean_value", F.abs("mean_value"))


# The local fit of a linear model is the model, in units of each feature's deviation.
@query(
    "lime_local_line",
    """WITH t AS (SELECT regr_slope(s_acctbal, s_suppkey) * stddev_pop(s_suppkey) AS w FROM supplier) SELECT s_suppkey, 's_suppkey' AS feature, round(w, 3) AS weight FROM supplier, t""",
)
def lime_line_query(spark, sf):
    data = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    model = _fitted(data, ["s_suppkey"], "s_acctbal", "linear_regression")
    renamed = data.withColumn("id", F.col("s_suppkey"))
    local = explain.lime_local(model, renamed, "id", ["s_suppkey"]).withColumnRenamed("id", "s_suppkey")
    return rounded(local, "weight", places=3)


@query("shap_sampling_tree")
def shap_tree_query(spark, sf):
    data = labelled_texts(spark, sf)
    model = _fitted(data, TEXT_FEATURES, "quality", "decision_tree_classifier")
    return explain.shap_sampling(model, data, "doc_id", TEXT_FEATURES, 8)


@query("lime_local")
def lime_query(spark, sf):
    data = labelled_texts(spark, sf)
    model = _fitted(data, TEXT_FEATURES, "quality", "logistic_regression")
    return explain.lime_local(model, data, "doc_id", TEXT_FEATURES)


@query(
    "top_k_features",
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS feature, round(abs(corr({c}, l_extendedprice)), 6) AS importance FROM lineitem)" for c in ("l_quantity", "l_partkey", "l_discount", "l_tax")
    )
    + " ORDER BY importance DESC LIMIT 3",
)
def top_query(spark, sf):
    names = ["l_quantity", "l_partkey", "l_discount", "l_tax"]
    row = table(spark, sf, "lineitem").agg(*[F.abs(F.corr(c, "l_extendedprice")).alias(c) for c in names])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(c, 6).alias("importance")) for c in names])
    return explain.top_k_features(row.select(F.inline(cells)), 3)

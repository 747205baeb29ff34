"""Model registry, versions, lineage and state logs, derived from orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.versions import parse_semver
from ..operators import lineage, registry
from ..sources import table
from .inputs import rounded, stamp
from .registry import query

MODELS = """models AS (SELECT o_orderkey AS model_id, 'Model_' || (o_custkey % 200) AS name,
  CASE WHEN o_custkey % 2 = 0 THEN 'classification' ELSE 'regression' END AS problem_type, o_orderpriority AS algorithm,
  o_totalprice / 1000 AS training_time, o_orderstatus AS status, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey * 7919 % 1000) / 1000 END AS cv_score,
  (o_orderkey * 104729 % 1000) / 1000 AS f1_score, (o_orderkey * 1299709 % 1000) / 1000 AS r2_score,
  (o_orderkey % 3) || '.' || (o_orderkey % 17) || '.' || (o_orderkey % 11) AS version, o_orderkey % 13 = 0 AS broken, o_orderkey % 4 <> 0 AS is_active,
  list_filter(['price', 'age', 'size', 'lang'], lambda x: (o_orderkey // CASE x WHEN 'price' THEN 1 WHEN 'age' THEN 2 WHEN 'size' THEN 4 ELSE 8 END) % 3 <> 0) AS features,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'y' || (o_orderkey % 2) END AS target_column FROM orders)"""


def models(spark, sf):
    k = F.col("o_orderkey")
    weights = {"price": 1, "age": 2, "size": 4, "lang": 8}
    features = F.array_compact(F.array(*[F.when(F.floor(k / w) % 3 != 0, F.lit(f)) for f, w in weights.items()]))
    return table(spark, sf, "orders").select(
        k.alias("model_id"),
        F.concat(F.lit("Model_"), (F.col("o_custkey") % 200).cast("string")).alias("name"),
        F.when(F.col("o_custkey") % 2 == 0, "classification").otherwise("regression").alias("problem_type"),
        F.col("o_orderpriority").alias("algorithm"),
        (F.col("o_totalprice") / 1000).alias("training_time"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(k % 5 != 0, (k * 7919 % 1000) / 1000).alias("cv_score"),
        ((k * 104729 % 1000) / 1000).alias("f1_score"),
        ((k * 1299709 % 1000) / 1000).alias("r2_score"),
        F.concat_ws(".", (k % 3).cast("string"), (k % 17).cast("string"), (k % 11).cast("string")).alias("version"),
        (k % 13 == 0).alias("broken"),
        (k % 4 != 0).alias("is_active"),
        features.alias("features"),
        F.when(k % 10 != 0, F.concat(F.lit("y"), (k % 2).cast("string"))).alias("target_column"),
    )


def month():
    """Ranges that a name's history is cut into."""
    return F.trunc("created_at", "MM")


@query(
    "registry_filter",
    f"WITH {MODELS} SELECT model_id, name, status FROM models WHERE lower(name) LIKE '%model_1%' AND list_has_any(features, ['age', 'lang']) AND status = 'P'",
)
def filter_query(spark, sf):
    df = models(spark, sf).withColumn("tags", F.col("features")).withColumn("updated_at", F.col("created_at"))
    return registry.registry_filter(df, "MODEL_1", ["age", "lang"], "P").select("model_id", "name", "status")


@query(
    "model_summary",
    f"""WITH {MODELS} SELECT count(*) AS total_models, count(*) FILTER (WHERE problem_type = 'classification') AS classification_models,
    count(*) FILTER (WHERE problem_type = 'regression') AS regression_models, count(*) FILTER (WHERE broken) AS broken_models,
    count(*) FILTER (WHERE NOT broken) AS healthy_models, round(avg(training_time), 6) AS average_training_time, round(sum(training_time), 2) AS total_training_time FROM models""",
)
def summary_query(spark, sf):
    return rounded(rounded(registry.model_summary(models(spark, sf)), "average_training_time"), "total_training_time", places=2)


@query("algorithm_distribution", f"WITH {MODELS} SELECT algorithm, count(*) AS models FROM models GROUP BY 1")
def algorithms_query(spark, sf):
    return registry.algorithm_distribution(models(spark, sf))


SCORED = "s AS (SELECT model_id, problem_type, coalesce(cv_score, CASE problem_type WHEN 'classification' THEN f1_score ELSE r2_score END) AS score FROM models)"


@query(
    "model_leaderboard",
    f"WITH {MODELS}, {SCORED} SELECT model_id, problem_type, score, CAST(row_number() OVER (PARTITION BY problem_type ORDER BY score DESC, model_id) AS INTEGER) AS position FROM s",
)
def leaderboard_query(spark, sf):
    return registry.model_leaderboard(models(spark, sf)).select("model_id", "problem_type", "score", "position")


@query(
    "model_best",
    f"WITH {MODELS}, {SCORED} SELECT model_id, problem_type, score, CAST(row_number() OVER (PARTITION BY problem_type ORDER BY score DESC, model_id) AS INTEGER) AS position FROM s QUALIFY position <= 3",
)
def best_query(spark, sf):
    return registry.model_leaderboard(models(spark, sf), 3).select("model_id", "problem_type", "score", "position")


@query(
    "latest_version",
    f"WITH {MODELS} SELECT name, arg_max(version, list_transform(string_split(version, '.'), lambda x: CAST(x AS INTEGER))) AS version FROM models GROUP BY 1",
)
def latest_query(spark, sf):
    return registry.latest_version(models(spark, sf))


LONG = "version || CASE WHEN model_id % 6 = 1 THEN '-rc' || (model_id % 5) ELSE '' END || CASE WHEN model_id % 7 = 2 THEN '+b' || (model_id % 9) ELSE '' END || CASE WHEN model_id % 29 = 3 THEN '.x.y' ELSE '' END"
RE = r"^(\d+)\.(\d+)\.(\d+)(?:-([^+]+))?(?:\+(.+))?$"


@query(
    "parse_semver",
    f"""WITH {MODELS}, v AS (SELECT model_id, {LONG} AS text FROM models)
    SELECT model_id, text, """
    + ", ".join(f"CAST(nullif(regexp_extract(text, '{RE}', {i + 1}), '') AS INTEGER) AS {n}" for i, n in enumerate(("major", "minor", "patch")))
    + f", nullif(regexp_extract(text, '{RE}', 4), '') AS prerelease, nullif(regexp_extract(text, '{RE}', 5), '') AS build FROM v",
)
def semver_query(spark, sf):
    k = F.col("model_id")

    def tail(mod, rest, prefix, size):
        return F.when(k % mod == rest, F.concat(F.lit(prefix), (k % size).cast("string"))).otherwise("")

    text = F.concat("version", tail(6, 1, "-rc", 5), tail(7, 2, "+b", 9), F.when(k % 29 == 3, ".x.y").otherwise(""))
    df = models(spark, sf).select("model_id", text.alias("text"))
    return df.withColumn("v", parse_semver(F.col("text"))).select("model_id", "text", "v.*")


LAG = "lag({c}) OVER (PARTITION BY name ORDER BY created_at, model_id)"
PAIRS = (
    "p AS (SELECT *, "
    + ", ".join(f"{LAG.format(c=c)} AS prev_{c}" for c in registry.FIELDS)
    + " FROM models), c AS (SELECT *, list_filter(prev_features, lambda x: NOT list_contains(features, x)) AS removed, "
    + "list_filter(features, lambda x: NOT list_contains(prev_features, x)) AS added, target_column IS DISTINCT FROM prev_target_column AS target_changed, "
    + "algorithm <> prev_algorithm AS algorithm_changed, problem_type <> prev_problem_type AS type_changed FROM p WHERE prev_version IS NOT NULL), "
    + "b AS (SELECT *, len(removed) > 0 OR len(added) > 0 OR target_changed OR algorithm_changed OR type_changed AS breaking FROM c)"
)


@query(
    "breaking_changes",
    f"""WITH {MODELS}, {PAIRS} SELECT name, model_id, array_to_string(list_sort(removed), ',') AS removed_features, array_to_string(list_sort(added), ',') AS added_features,
    target_changed, algorithm_changed, type_changed, breaking FROM b""",
)
def breaking_query(spark, sf):
    return registry.breaking_changes(models(spark, sf), month()).select(
        "name", "model_id", "removed_features", "added_features", "target_changed", "algorithm_changed", "type_changed", "breaking"
    )


@query(
    "version_compatible",
    f"""WITH {MODELS}, {PAIRS} SELECT name, model_id, prev_version, version, split_part(prev_version, '.', 1) = split_part(version, '.', 1) AS compatible,
    CASE WHEN breaking THEN (CAST(split_part(prev_version, '.', 1) AS INTEGER) + 1) || '.0.0'
      ELSE split_part(prev_version, '.', 1) || '.' || (CAST(split_part(prev_version, '.', 2) AS INTEGER) + 1) || '.0' END AS suggested_version FROM b""",
)
def compatible_query(spark, sf):
    return registry.version_advice(models(spark, sf), month())


@query("suggest_next_version", f"WITH {MODELS}, {PAIRS} SELECT model_id, breaking, CASE WHEN breaking THEN (CAST(split_part(prev_version, '.', 1) AS INTEGER) + 1) || '.0.0' ELSE split_part(prev_version, '.', 1) || '.' || (CAST(split_part(prev_version, '.', 2) AS INTEGER) + 1) || '.0' END AS suggested_version FROM b")
def next_version_query(spark, sf):
    from ..functions.versions import next_version

    changes = registry.breaking_changes(models(spark, sf), month())
    return changes.select("model_id", "breaking", next_version(F.col("prev_version"), F.col("breaking")).alias("suggested_version"))


@query("version_history", f"WITH {MODELS} SELECT name, model_id, version, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM models WHERE is_active")
def history_query(spark, sf):
    df = registry.version_history(models(spark, sf)).select("name", "model_id", "version", "created_at")
    return df.withColumn("created_at", stamp("created_at"))


@query("model_info", f"WITH {MODELS} SELECT model_id, name, problem_type, algorithm, version FROM models WHERE model_id = 77")
def info_query(spark, sf):
    return registry.model_info(models(spark, sf), 77).select("model_id", "name", "problem_type", "algorithm", "version")


@query(
    "model_config_export",
    f"""WITH {MODELS}, j AS (SELECT model_id, '{{"problem_type":"' || problem_type || '","algorithm":"' || algorithm || '","feature_columns":' ||
      CASE WHEN len(features) = 0 THEN '[]' ELSE '["' || array_to_string(features, '","') || '"]' END || CASE WHEN target_column IS NULL THEN '' ELSE ',"target_column":"' || target_column || '"' END || '}}' AS config FROM models)
    SELECT model_id, config, substr(sha256(config), 1, 16) AS reproducibility_hash FROM j""",
)
def export_query(spark, sf):
    return registry.model_config_export(models(spark, sf)).drop("performance")


GATES = [
    ("good_f1", "f1_score", "greater_equal", 0.3, True),
    ("high_cv", "cv_score", "greater_than", 0.5, False),
    ("fast", "training_time", "less_than", 400.0, True),
    ("whole_r2", "r2_score", "less_equal", 0.9, True),
    ("exact", "r2_score", "equal", 0.5, False),
]
GATE_ROWS = " UNION ALL ".join(
    f"SELECT '{g}' AS gate, '{m}' AS metric, '{c}' AS comparison, {t} AS threshold, {str(r).lower()} AS required" for g, m, c, t, r in GATES
)
METRICS = "UNPIVOT (SELECT model_id, cv_score, f1_score, r2_score, training_time FROM models) ON cv_score, f1_score, r2_score, training_time INTO NAME metric VALUE value"


@query(
    "quality_gate",
    f"""WITH {MODELS}, g AS ({GATE_ROWS}), m AS (SELECT * FROM ({METRICS})) SELECT model_id, gate, m.metric, comparison, threshold, value AS actual,
    CASE comparison WHEN 'greater_equal' THEN value >= threshold WHEN 'greater_than' THEN value > threshold WHEN 'less_than' THEN value < threshold
      WHEN 'less_equal' THEN value <= threshold ELSE value = threshold END AS passed, required FROM m JOIN g ON m.metric = g.metric""",
)
def gate_query(spark, sf):
    gates = spark.createDataFrame(GATES, "gate string, metric string, comparison string, threshold double, required boolean")
    values = models(spark, sf).unpivot(["model_id"], ["cv_score", "f1_score", "r2_score", "training_time"], "metric", "value")
    return registry.quality_gate(values.filter(F.col("value").isNotNull()), gates)


NODES = "nodes AS (SELECT o_orderkey AS id, list_distinct([o_orderkey // 3, o_orderkey // 5]) AS deps FROM orders)"


def transformations(spark, sf):
    k = F.col("o_orderkey")
    deps = F.array_distinct(F.array(F.floor(k / 3), F.floor(k / 5)))
    return table(spark, sf, "orders").select(k.alias("transformation_id"), deps.alias("dependencies"))


@query(
    "lineage_chain",
    f"""WITH RECURSIVE {NODES}, chain AS (SELECT id AS root, id, 0 AS level FROM nodes
      UNION SELECT c.root, d.dep, c.level + 1 FROM chain c JOIN (SELECT id, unnest(deps) AS dep FROM nodes) d ON c.id = d.id WHERE c.level < 10)
    SELECT root, count(*) AS reached, CAST(sum(level) AS BIGINT) AS levels, min(id) AS first_id, max(level) AS deepest FROM (SELECT root, id, min(level) AS level FROM chain GROUP BY 1, 2) GROUP BY 1""",
)
def chain_query(spark, sf):
    nodes = transformations(spark, sf)
    chain = lineage.lineage_chain(nodes, nodes.select(F.col("transformation_id").alias("root")))
    return chain.groupBy("root").agg(
        F.count("*").alias("reached"), F.sum("level").alias("levels"), F.min("transformation_id").alias("first_id"), F.max("level").alias("deepest")
    )


@query(
    "lineage_cycle_check",
    """WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey // 3 AS parent_id, o_orderkey AS child_id FROM orders WHERE o_orderkey > 0),
    cand AS (SELECT DISTINCT o_orderkey AS parent_id, o_orderkey // CASE WHEN o_custkey % 2 = 0 THEN 9 ELSE 7 END AS child_id FROM orders),
    r AS (SELECT parent_id, child_id, child_id AS node FROM cand UNION SELECT r.parent_id, r.child_id, e.child_id FROM r JOIN e ON e.parent_id = r.node AND r.node <> r.parent_id)
    SELECT c.parent_id, c.child_id, EXISTS (SELECT 1 FROM r WHERE r.parent_id = c.parent_id AND r.child_id = c.child_id AND r.node = c.parent_id) AS creates_cycle FROM cand c""",
)
def cycle_query(spark, sf):
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    edges = orders.filter(k > 0).select(F.floor(k / 3).alias("parent_id"), k.alias("child_id"))
    factor = F.when(F.col("o_custkey") % 2 == 0, 9).otherwise(7)
    return lineage.lineage_cycle_check(edges, orders.select(k.alias("parent_id"), F.floor(k / factor).alias("child_id")))


@query(
    "transform_history",
    """SELECT user_id AS dataset_id, count(*) AS operations, count(DISTINCT event_type) AS methods,
    string_agg(DISTINCT 'c' || (event_id % 7), ',' ORDER BY 'c' || (event_id % 7)) AS columns_modified,
    CAST(sum(('0x' || substr(md5(concat_ws('|', event_type, 'c' || (event_id % 7), event_id)), 1, 13))::BIGINT) AS VARCHAR) AS history_hash FROM events GROUP BY 1""",
)
def transform_history_query(spark, sf):
    column = F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string"))
    ops = table(spark, sf, "events").select(
        F.col("user_id").alias("dataset_id"), F.col("event_type").alias("method"), column.alias("column"), F.col("event_id").alias("seq")
    )
    return lineage.transform_history(ops)


@query(
    "lineage_upsert",
    """WITH u AS (SELECT user_id * 1000 + CAST(floor(value) AS BIGINT) % 50 AS transformation_id, event_id AS seq, event_type AS operation_type FROM events)
    SELECT transformation_id, max(seq) AS seq, arg_max(operation_type, seq) AS operation_type FROM u GROUP BY 1""",
)
def upsert_query(spark, sf):
    ident = F.col("user_id") * 1000 + F.floor("value") % 50
    ops = table(spark, sf, "events").select(ident.alias("transformation_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("operation_type"), "ts")
    early, late = ops.filter("ts < '2024-01-20'").drop("ts"), ops.filter("ts >= '2024-01-20'").drop("ts")
    return lineage.lineage_upsert(early, late)


@query(
    "edge_upsert",
    """SELECT user_id AS parent_id, CAST(floor(value) AS BIGINT) AS child_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM events GROUP BY 1, 2""",
)
def edge_query(spark, sf):
    edges = table(spark, sf, "events").select(F.col("user_id").alias("parent_id"), F.floor("value").alias("child_id"), F.col("ts").alias("created_at"))
    out = lineage.edge_upsert(edges.filter("created_at < '2024-01-20'"), edges.filter("created_at >= '2024-01-20'"))
    return out.withColumn("created_at", stamp("created_at"))


STATE = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END"


def state_log(spark, sf):
    kinds = {"view": "pending", "click": "running", "purchase": "completed", "error": "failed"}
    status = F.lit("cancelled")
    for event, state in kinds.items():
        status = F.when(F.col("event_type") == event, F.lit(state)).otherwise(status)
    return table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), status.alias("status"))


@query("replay_state_log", f"SELECT user_id AS run_id, arg_max({STATE}, event_id) AS status, count(*) AS changes FROM events GROUP BY 1")
def replay_log_query(spark, sf):
    return registry.replay_state_log(state_log(spark, sf))


@query(
    "invalid_transitions",
    f"""WITH s AS (SELECT user_id AS run_id, event_id AS seq, {STATE} AS status FROM events),
    p AS (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY seq) AS prev_status FROM s)
    SELECT run_id, seq, status, prev_status FROM p WHERE prev_status IS NOT NULL AND NOT (
      (prev_status = 'pending' AND status IN ('running', 'cancelled')) OR (prev_status = 'running' AND status IN ('completed', 'failed', 'cancelled')) OR (prev_status = 'failed' AND status = 'running'))""",
)
def transitions_query(spark, sf):
    return registry.invalid_transitions(state_log(spark, sf), F.floor(F.col("seq") / 2000))

"""Chart data, distributions and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import request_cost, sanitize_text
from ..operators import chart, correlation
from ..sources import table
from .inputs import GAPS, orders_with_gaps, rounded, stamp
from .registry import query

HIST = """m AS (SELECT count({c}) AS n, min({c}) AS lo, max({c}) AS hi, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM {t}),
  b AS (SELECT lo, hi, {bins} AS bins FROM m),
  w AS (SELECT lo, bins, (hi - lo) / bins AS width FROM b),
  c AS (SELECT CAST(least(floor(({c} - lo) / width), bins - 1) AS INTEGER) AS bin, count(*) AS n FROM {t}, w WHERE {c} IS NOT NULL GROUP BY 1)
  SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * width, 6) AS lower, round(lo + (g.bin + 1) * width, 6) AS upper, coalesce(n, 0) AS n
  FROM (SELECT unnest(range(CAST(bins AS BIGINT))) AS bin FROM w) g LEFT JOIN c ON g.bin = c.bin, w"""


@query("histogram_bins", f"WITH {GAPS}, " + HIST.format(c="o_totalprice", t="o", bins="30"))
def histogram_query(spark, sf):
    return rounded(chart.histogram_bins(orders_with_gaps(spark, sf), "o_totalprice", 30), "lower", "upper")


@query(
    "histogram_auto_bins",
    "WITH " + HIST.format(c="l_extendedprice", t="lineitem", bins="ceil((hi - lo) / least(2 * iqr / pow(n, 1.0 / 3), (hi - lo) / (log2(n) + 1)))"),
)
def histogram_auto_query(spark, sf):
    return rounded(chart.histogram_bins(table(spark, sf, "lineitem"), "l_extendedprice"), "lower", "upper")


@query("category_counts", f"WITH {GAPS} SELECT o_orderpriority AS category, count(*) AS n FROM o WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def category_query(spark, sf):
    return chart.category_counts(orders_with_gaps(spark, sf), "o_orderpriority")


@query(
    "histogram_kde",
    """WITH m AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd FROM events),
    p AS (SELECT *, (hi - lo) / 512 AS width, (hi - lo) / 199 AS step, sd * pow(n, -0.2) AS band FROM m),
    b AS (SELECT least(floor((value - lo) / width), 511) AS bin, count(*) AS c FROM events, p GROUP BY 1),
    g AS (SELECT unnest(range(200)) AS point)
    SELECT CAST(point AS INTEGER) AS point, round(any_value(lo + point * step), 6) AS x,
    round(sum(c * exp(-pow((lo + point * step - (lo + (bin + 0.5) * width)) / band, 2) / 2)) / any_value(n * band * sqrt(2 * pi())), 8) AS density
    FROM b, g, p GROUP BY 1""",
)
def kde_query(spark, sf):
    df = chart.histogram_kde(table(spark, sf, "events"), "value")
    return df.withColumns({"x": F.round("x", 6), "density": F.round("density", 8)})


@query(
    "column_summary",
    f"WITH {GAPS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_values, count(*) AS total_values FROM o"""
        for c, t in (("o_totalprice", "double"), ("o_orderpriority", "string"), ("o_custkey", "bigint"))
    ),
)
def summary_query(spark, sf):
    return chart.column_summary(orders_with_gaps(spark, sf), ["o_totalprice", "o_orderpriority", "o_custkey"])


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(expr, columns, source="lineitem", extra=""):
    cells = []
    for x in columns:
        for y in columns:
            value = "1.0" if x == y else f"round({expr.format(x=x, y=y)}, 6)"
            cells.append(f"SELECT '{x}' AS x, '{y}' AS y, {value} AS corr FROM {source}" + (" LIMIT 1" if x == y else ""))
    return extra + " UNION ALL ".join(f"({c})" for c in cells)


@query("corr_pearson", _corr_sql("corr({x}, {y})", LINE))
def pearson_query(spark, sf):
    return rounded(correlation.corr_pearson(table(spark, sf, "lineitem"), LINE), "corr")


RANKS = "WITH r AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in LINE
) + " FROM lineitem) "


@query("corr_spearman", _corr_sql("corr({x}, {y})", LINE, "r", RANKS))
def spearman_query(spark, sf):
    return rounded(correlation.corr_spearman(table(spark, sf, "lineitem"), LINE), "corr")


@query(
    "corr_kendall",
    """WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS n FROM lineitem GROUP BY 1, 2),
    p AS (SELECT sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM c a, c b),
    t AS (SELECT (SELECT sum(CAST(k AS DOUBLE) * (k - 1) / 2) FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_quantity)) AS tx,
      (SELECT sum(CAST(k AS DOUBLE) * (k - 1) / 2) FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_discount)) AS ty,
      (SELECT CAST(count(*) AS DOUBLE) * (count(*) - 1) / 2 FROM lineitem) AS n0),
    r AS (SELECT round(s / sqrt((n0 - tx) * (n0 - ty)), 6) AS tau FROM p, t)
    SELECT 'l_quantity' AS x, 'l_discount' AS y, tau AS corr FROM r UNION ALL SELECT 'l_discount', 'l_quantity', tau FROM r
    UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0 UNION ALL SELECT 'l_discount', 'l_discount', 1.0""",
)
def kendall_query(spark, sf):
    return rounded(correlation.corr_kendall(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]), "corr")


@query(
    "top_correlations",
    "WITH c AS ("
    + " UNION ALL ".join(
        f"SELECT '{min(x, y)}' AS x, '{max(x, y)}' AS y, round(corr({x}, {y}), 6) AS corr FROM lineitem"
        for i, x in enumerate(LINE)
        for y in LINE[i + 1 :]
    )
    + """) (SELECT 'strongest_positive' AS kind, x, y, corr FROM c ORDER BY corr DESC LIMIT 1)
    UNION ALL (SELECT 'strongest_negative', x, y, corr FROM c ORDER BY corr LIMIT 1)""",
)
def top_corr_query(spark, sf):
    matrix = rounded(correlation.corr_pearson(table(spark, sf, "lineitem"), LINE), "corr")
    return correlation.top_correlations(matrix)


@query(
    "corr_strength_label",
    "WITH c AS ("
    + _corr_sql("corr({x}, {y})", LINE)
    + """) SELECT x, y, corr, CASE WHEN corr > 0.7 THEN 'strong positive' WHEN corr > 0.3 THEN 'moderate positive' WHEN corr > -0.3 THEN 'weak'
    WHEN corr > -0.7 THEN 'moderate negative' ELSE 'strong negative' END AS strength FROM c""",
)
def strength_query(spark, sf):
    return correlation.labelled(rounded(correlation.corr_pearson(table(spark, sf, "lineitem"), LINE), "corr"))


@query(
    "scatter_points",
    f"WITH {GAPS} SELECT o_custkey AS x, o_totalprice AS y, o_orderstatus AS color FROM o WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL",
)
def scatter_query(spark, sf):
    return chart.scatter_points(orders_with_gaps(spark, sf), "o_custkey", "o_totalprice", "o_orderstatus")


@query(
    "scatter_summary",
    f"""WITH {GAPS} SELECT o_orderstatus AS color, count(*) AS points, min(o_custkey) AS x_min, max(o_custkey) AS x_max, min(o_totalprice) AS y_min,
    max(o_totalprice) AS y_max, round(corr(o_custkey, o_totalprice), 6) AS corr FROM o WHERE o_totalprice IS NOT NULL GROUP BY 1""",
)
def scatter_summary_query(spark, sf):
    return rounded(chart.scatter_summary(orders_with_gaps(spark, sf), "o_custkey", "o_totalprice", "o_orderstatus"), "corr")


@query(
    "box_stats",
    """WITH b AS (SELECT event_type AS category, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
    f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b)
    SELECT category, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n,
    min(value) FILTER (WHERE value BETWEEN lo AND hi) AS whisker_low, max(value) FILTER (WHERE value BETWEEN lo AND hi) AS whisker_high,
    count(*) FILTER (WHERE NOT value BETWEEN lo AND hi) AS outliers FROM events JOIN f ON event_type = category GROUP BY category, q1, median, q3""",
)
def box_query(spark, sf):
    return rounded(chart.box_stats(table(spark, sf, "events"), "event_type", "value"), "q1", "median", "q3")


def _distribution(c: str, t: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std,
    CAST(min({c}) AS DOUBLE) AS minimum, CAST(max({c}) AS DOUBLE) AS maximum, round(skewness({c}), 6) AS skew,
    CASE WHEN abs(skewness({c})) < 0.5 THEN 'approximately normal' WHEN skewness({c}) > 0.5 THEN 'right-skewed' ELSE 'left-skewed' END AS shape,
    (SELECT count(*) FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})
      WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers FROM {t}"""


@query("distribution_summary", _distribution("l_extendedprice", "lineitem") + " UNION ALL " + _distribution("l_quantity", "lineitem"))
def distribution_query(spark, sf):
    df = chart.distribution_summary(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])
    return rounded(df, "mean", "median", "std", "skew")


@query("time_series", "SELECT event_type AS series, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, value FROM events ORDER BY 1, 2, 3")
def series_query(spark, sf):
    return chart.time_series(table(spark, sf, "events"), "ts", "value", "event_type").withColumn("ts", stamp("ts"))


@query(
    "time_series_rollup",
    """SELECT event_type AS series, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS minimum, max(value) AS maximum,
    strftime(date_trunc('day', ts), '%Y-%m-%d') AS bucket FROM events GROUP BY 1, date_trunc('day', ts)""",
)
def rollup_query(spark, sf):
    df = chart.time_series_rollup(table(spark, sf, "events"), "ts", "value", "1 day", "event_type")
    return rounded(df, "mean").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query(
    "trend_label",
    """WITH t AS (SELECT event_type AS series, count(*) AS n, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value,
      CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6) AS BIGINT) AS duration_days FROM events GROUP BY 1),
    c AS (SELECT *, (last_value - first_value) / abs(first_value) * 100 AS p FROM t)
    SELECT series, n, first_value, last_value, round(p, 6) AS change_percent,
    CASE WHEN p > 10 THEN 'increasing' WHEN p < -10 THEN 'decreasing' ELSE 'relatively stable' END AS trend, duration_days FROM c""",
)
def trend_query(spark, sf):
    return rounded(chart.time_series_trend(table(spark, sf, "events"), "ts", "value", "event_type"), "change_percent")


@query(
    "data_table",
    """WITH s AS (SELECT * FROM orders ORDER BY ('0x' || substr(md5(concat_ws('|', '42', o_orderkey)), 1, 13))::BIGINT, o_orderkey LIMIT 100)
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, printf('%.3f', o_totalprice) AS o_totalprice FROM s""",
)
def data_table_query(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return chart.data_table(df, "o_orderkey")


@query(
    "sanitize_text",
    """SELECT page_id, replace(replace(replace(replace(replace(html, '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '&', '&amp;'), '''', '&#x27;') AS html FROM pages""",
)
def sanitize_query(spark, sf):
    return table(spark, sf, "pages").select("page_id", sanitize_text(F.col("html")).alias("html"))


@query(
    "request_cost",
    """SELECT event_id, round(log10(greatest(user_id * 1000.0 + 1, 10)) / 4
      * CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 1.2 WHEN 'signup' THEN 1.5 WHEN 'purchase' THEN 2.0 ELSE 1.0 END
      * CASE WHEN event_id % 2 = 0 THEN 1.5 ELSE 1.0 END * CASE WHEN event_id % 3 = 0 THEN 2.0 ELSE 1.0 END
      * CASE WHEN event_id % 5 = 0 THEN 3.0 ELSE 1.0 END, 2) AS cost FROM events""",
)
def cost_query(spark, sf):
    kinds = {"click": "histogram", "view": "scatter", "signup": "boxplot", "purchase": "timeseries"}
    chart_type = F.lit("other")
    for event, kind in kinds.items():
        chart_type = F.when(F.col("event_type") == event, F.lit(kind)).otherwise(chart_type)
    i = F.col("event_id")
    cost = request_cost(F.col("user_id") * 1000.0 + 1, chart_type, i % 2 == 0, i % 3 == 0, i % 5 == 0)
    return table(spark, sf, "events").select("event_id", cost.alias("cost"))

"""URL judgements: given host and path rules first, association rules mined from labels for the rest.

Spark's FP-growth mines sets of URL tokens from the labelled rows. Tokens that the same labelled rows have are one group, of which a
URL needs any one member: that says all that the sets of its members would say. Rules that lead to `block` are pruned
by support, confidence and lift, and where a shorter rule is as sure; they are found for a URL by an inverted index: each rule is
filed under its rarest group, and only rules filed under a URL's own groups are tried. Rows with very many groups have more sets than can
be listed; there only sets are followed that no shorter one has the rows of.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import q
from ..session import durable
from .common import query, read

# The rules of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

BLOCKED = "label=block"
INDEX_RULES = 200_000  # rules that one index may hold; beyond it the support has to be raised
MOST_GROUPS = 14  # groups in a row up to which all of their sets are listed

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule; a rule is `host/path`, given as a short list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels by place from the end, path words and keys of the query; digits become #."""
    text = F.lower(F.coalesce(url, F.lit("")))
    scheme = F.regexp_extract(text, r"^([a-z][a-z0-9+.-]*)://", 1)
    labels = F.reverse(F.split(host_of(url), r"\."))
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x))
    words = F.transform(F.split(F.regexp_replace(F.lower(path_of(url)), r"\d+", "#"), r"[/._-]+"), lambda x: F.concat(F.lit("path="), x))
    asked = F.split(F.regexp_replace(F.regexp_extract(text, r"\?([^#]*)", 1), r"=[^&]*", ""), "&")
    keys = F.transform(asked, lambda x: F.concat(F.lit("query="), x))
    part = F.when(text.contains("#"), F.array(F.lit("part=")))
    found = F.concat(F.array(F.concat(F.lit("scheme="), scheme)), hosts, words, keys, F.coalesce(part, F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~x.endswith("="))))


@dataclass(frozen=True)
class Rule:
    groups: tuple[str, ...]
    confidence: float
    support: int


@dataclass
class Rules:
    """Mined rules over groups of tokens; `group_of` names the group of each token that takes part."""

    rules: list[Rule]
    group_of: dict[str, str]


def token_groups(rows: DataFrame, needed: float) -> DataFrame:
    """`(token, grp)` from `(row, blocked, tokens)`: tokens with enough blocked rows, those of the same rows in one group.

    Rows are told apart by sums of two hashes. Tokens that every row has say nothing and are left out.
    """
    total = rows.count()
    cells = rows.select("row", "blocked", F.explode("tokens").alias("token"))
    sums = [F.sum(F.xxhash64(F.col("row"), F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(2)]
    marks = cells.groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("b"), *sums)
    kept = marks.filter((F.col("b") >= needed) & (F.col("n") < total))
    names = kept.groupBy("n", "s0", "s1").agg(F.min("token").alias("grp"), F.collect_list("token").alias("tokens"))
    return names.select(F.explode("tokens").alias("token"), "grp")


def _sets_by_growth(rows: DataFrame, needed: float, least: float) -> DataFrame:
    """`(groups, support, confidence)` of all sets with enough blocked rows, by FP-growth."""
    total = rows.count()
    marked = rows.select(F.when(F.col("blocked"), F.concat("groups", F.array(F.lit(BLOCKED)))).otherwise(F.col("groups")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(needed / total - 1e-9, 0.0), minConfidence=least).fit(marked)
    found = model.associationRules.filter((F.size("consequent") == 1) & F.array_contains("consequent", BLOCKED))
    return found.select(F.array_sort("antecedent").alias("groups"), F.round(F.col("support") * total).cast("long").alias("support"), "confidence")


def _sets_by_levels(rows: DataFrame, needed: float) -> DataFrame:
    """The same without sets that have the rows of a smaller one, level by level: each is as sure as the smaller one.

    All parts of a set that is kept are kept, so a level is built from pairs of the one before that differ in their last group.
    """
    level = durable(rows.select("row", "blocked", F.explode("groups").alias("g")).select("row", "blocked", F.array("g").alias("groups")))
    counted = durable(level.groupBy("groups").agg(F.count("*").alias("n"), F.count_if("blocked").alias("support")))
    found, size = counted, 1
    while True:
        head, last = F.slice("groups", 1, size - 1), F.element_at("groups", -1)
        left = level.select("row", "blocked", "groups", head.alias("head"), last.alias("last"))
        right = level.select(F.col("row").alias("r"), head.alias("h"), last.alias("l"))
        pairs = left.join(right, (F.col("row") == F.col("r")) & (F.col("head") == F.col("h")) & (F.col("last") < F.col("l")))
        pairs = pairs.select("row", "blocked", F.concat("groups", F.array("l")).alias("groups"))
        sums = pairs.groupBy("groups").agg(F.count("*").alias("n"), F.count_if("blocked").alias("support")).filter(F.col("support") >= needed)
        parts = sums.select("groups", "n", F.explode("groups").alias("out")).select("groups", "n", F.array_remove("groups", F.col("out")).alias("part"))
        known = counted.select(F.col("groups").alias("part"), F.col("n").alias("m"))
        own = parts.join(known, "part").filter(F.col("n") < F.col("m")).groupBy("groups").agg(F.count("*").alias("parts")).filter(F.col("parts") == size + 1)
        counted = durable(sums.join(own.select("groups"), "groups"))
        if counted.isEmpty():
            break
        level = durable(pairs.join(counted.select("groups"), "groups", "left_semi"))
        found, size = found.unionByName(counted), size + 1
    return found.select("groups", "support", (F.col("support") / F.col("n")).alias("confidence"))


def mine_rules(
    labelled: DataFrame, tokens: str = "tokens", blocked: str = "blocked", min_share: float = 0.005, min_rows: int = 5,
    min_confidence: float = 0.5, min_lift: float = 1.2, most_groups: int = MOST_GROUPS,
) -> Rules:
    """Rules `tokens -> block` from all labelled rows; no labelled rows give no rules.

    A rule needs `min_rows` and `min_share` of the rows with its tokens and the label together, and the
    confidence and lift given; its number of tokens has no bound. Rules that hold a rule which is as sure are left out: they decide nothing.
    """
    rows = durable(labelled.select(q(tokens).alias("tokens"), q(blocked).alias("blocked")).withColumn("row", F.monotonically_increasing_id()))
    total, hits = rows.agg(F.count("*"), F.count_if("blocked")).first()
    needed = max(min_rows, min_share * total)
    if not total or hits < needed:
        return Rules([], {})
    groups = durable(token_groups(rows, needed))
    # Each row has few tokens, so few tokens can have a share of all rows.
    group_of = {r["token"]: r["grp"] for r in groups.collect()}
    cells = rows.select("row", "blocked", F.explode("tokens").alias("token")).join(groups, "token")
    marked = durable(cells.groupBy("row", "blocked").agg(F.array_sort(F.collect_set("grp")).alias("groups")))
    most = marked.agg(F.max(F.size("groups"))).first()[0] or 0
    if not most:
        return Rules([], {})
    sets = _sets_by_growth(marked, needed, min_confidence) if most <= most_groups else _sets_by_levels(marked, needed)
    sure = sets.filter(
        (F.col("support") >= needed - 1e-9) & (F.col("confidence") >= min_confidence) & (F.col("confidence") / (hits / total) >= min_lift)
    )
    found = sure.limit(INDEX_RULES + 1).collect()
    if len(found) > INDEX_RULES:
        raise ValueError(f"more than {INDEX_RULES} rules; raise min_share")
    return Rules(shortest([Rule(tuple(r["groups"]), r["confidence"], r["support"]) for r in found]), group_of)


def shortest(rules: Sequence[Rule]) -> list[Rule]:
    """Rules of which no part is a rule that is as sure."""
    kept: dict[str, list[Rule]] = defaultdict(list)
    out = []
    for rule in sorted(rules, key=lambda r: (len(r.groups), r.groups)):
        own = set(rule.groups)
        if not any(k.confidence >= rule.confidence and own.issuperset(k.groups) for g in rule.groups for k in kept.get(g, ())):
            kept[rule.groups[0]].append(rule)
            out.append(rule)
    return out


def rule_index(rules: Sequence[Rule]) -> dict[str, list[Rule]]:
    """Each rule under that of its groups which the fewest rules have."""
    used = Counter(g for r in rules for g in r.groups)
    index: dict[str, list[Rule]] = defaultdict(list)
    for rule in rules:
        index[min(rule.groups, key=lambda g: (used[g], g))].append(rule)
    return dict(index)


def judge_urls(
    pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES, **mining: float,
) -> DataFrame:
    """One row per page: `page_id, host, path, rule, verdict, confidence`.

    A page is labelled when its path holds the number of a labelled document; it counts as blocked when
    that document is toxic or of low quality. Given rules win, the longest first. Other URLs
    are blocked when a mined rule fits, with the best confidence given, and allowed otherwise. A missing
    URL or one without `://` has an empty host and path and is allowed. A missing id stays as a row, repeated
    rows stay, empty tables give an empty result or no mined rules. Other columns are not read.
    """
    url = q(url_col).cast("string")
    narrow = pages.select(
        q(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), url_tokens(url).alias("tokens")
    )
    number = F.expr("try_cast(regexp_extract(path, '/(\\\\d+)', 1) AS bigint)")
    marks = labels.select(
        F.col("doc_id").alias("number"),
        (F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("blocked"),
    )
    marks = marks.filter("number is not null").groupBy("number").agg(F.max("blocked").alias("blocked"))
    labelled = narrow.select("tokens", number.alias("number")).join(marks, "number")
    mined_ = mine_rules(labelled, **mining)
    # Bounded by INDEX_RULES rules over tokens that a share of the labelled rows have.
    shared = pages.sparkSession.sparkContext.broadcast((mined_.group_of, rule_index(mined_.rules)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group_of, filed = shared.value
        for batch in batches:
            best = []
            for tokens in batch.column("tokens").to_pylist():
                own = {group_of[t] for t in tokens if t in group_of}
                fits = [r.confidence for g in own for r in filed.get(g, ()) if own.issuperset(r.groups)]
                best.append(max(fits) if fits else None)
            names = ["page_id", "host", "path"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(best, pa.float64())], names=[*names, "confidence"]
            )

    kind = narrow.schema["page_id"].dataType.simpleString()
    matched = narrow.mapInArrow(match, f"page_id {kind}, host string, path string, confidence double")
    name, verdict = first_rule(F.col("host"), F.col("path"), rules)
    mined = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return matched.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "confidence")


SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS s FROM pages),
p AS (SELECT page_id, url, CASE WHEN s > 0 THEN substr(url, s + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
raw AS (
  SELECT page_id, unnest(list_concat(
    ['scheme=' || regexp_extract(lower(url), '^([a-z][a-z0-9+.-]*)://', 1)],
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'host' || (i - 1) || '=' || list_reverse(string_split(host, '.'))[i]),
    list_transform(regexp_split_to_array(regexp_replace(lower(path), '\d+', '#', 'g'), '[/._-]+'), lambda x: 'path=' || x),
    list_transform(string_split(regexp_replace(regexp_extract(lower(url), '\?([^#]*)', 1), '=[^&]*', '', 'g'), '&'), lambda x: 'query=' || x),
    CASE WHEN contains(url, '#') THEN ['part='] ELSE [] END)) AS token FROM h),
tok AS (SELECT DISTINCT page_id, token FROM raw WHERE NOT ends_with(token, '=')),
lab AS (SELECT h.page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS blocked
  FROM h JOIN labels ON doc_id = try_cast(regexp_extract(path, '/(\d+)', 1) AS BIGINT) GROUP BY 1),
total AS (SELECT count(*) AS n, coalesce(sum(blocked), 0) AS b FROM lab),
lt AS (SELECT tok.*, blocked FROM tok JOIN lab USING (page_id)),
sets AS (
  SELECT [token] AS items, count(*) AS n, sum(blocked) AS b FROM lt GROUP BY 1
  UNION ALL SELECT [a.token, c.token], count(*), sum(a.blocked) FROM lt a JOIN lt c ON a.page_id = c.page_id AND a.token < c.token GROUP BY 1
  UNION ALL SELECT [a.token, c.token, d.token], count(*), sum(a.blocked) FROM lt a
    JOIN lt c ON a.page_id = c.page_id AND a.token < c.token JOIN lt d ON a.page_id = d.page_id AND c.token < d.token GROUP BY 1),
rules AS (SELECT items, sets.b / sets.n AS confidence FROM sets, total
  WHERE sets.b >= greatest(5, 0.005 * total.n) - 1e-6 AND sets.b / sets.n >= 0.5 AND (sets.b / sets.n) / (total.b / total.n) >= 1.2),
lists AS (SELECT page_id, list(token) AS tokens FROM tok GROUP BY 1),
mined AS (SELECT page_id, max(confidence) AS confidence FROM lists JOIN rules ON list_has_all(tokens, items) GROUP BY 1)
SELECT page_id, host, path,
  CASE WHEN fr3 THEN 'example.net/en/' WHEN fr2 THEN 'example.com/de/' WHEN fr1 THEN 'org/fr/' WHEN fr0 THEN 'net/' END AS rule,
  CASE WHEN fr3 THEN 'allow' WHEN fr2 THEN 'block' WHEN fr1 THEN 'allow' WHEN fr0 THEN 'block'
    WHEN confidence IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, confidence
FROM (SELECT h.*, confidence,
    (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') AS fr0,
    (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') AS fr1,
    (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') AS fr2,
    (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') AS fr3
  FROM h LEFT JOIN mined USING (page_id))"""


@query("op10_url_rules", SQL)
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))

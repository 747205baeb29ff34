"""Shards as runs of a Hilbert curve over several metadata dimensions.

Rows that are near in size, source and language lie near on the curve, so each shard covers a small box
in every dimension and a reader can skip most shards by their minima and maxima. All steps are
DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ranking import global_index
from ..schema import q
from .common import query, read

BITS = 6  # bits of each dimension
SHARDS = 16


def size_level(size: Column, bits: int = BITS) -> Column:
    """Four steps for each doubling of a size of at least 1, cut at the last level."""
    return F.least(F.floor(4 * F.log2(size.cast("double"))), F.lit((1 << bits) - 1)).cast("long")


def name_level(name: Column, bits: int = BITS) -> Column:
    """A fixed level for each name; a missing name shares the level of the empty one."""
    digest = F.md5(F.coalesce(name.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("long") % (1 << bits)


def hilbert_index(levels: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of points with coordinates below 2^bits, in any number of dimensions.

    From the highest bit down, each set bit inverts the lower bits of the first coordinate and each
    clear one exchanges them with it; Gray coding of the result and interleaving give the position.
    """
    dims = len(levels)
    names = [f"x{i}" for i in range(dims)]
    marks = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, -1, -1)])
    start = F.struct(*[c.cast("long").alias(n) for c, n in zip(levels, names)])

    def turn(point: Column, mark: Column) -> Column:
        low = mark - 1
        x = [point[n] for n in names]
        first = x[0]
        out = []
        for i, value in enumerate(x):
            set_ = value.bitwiseAND(mark) != 0
            if i == 0:
                first = F.when(set_, first.bitwiseXOR(low)).otherwise(first)
                continue
            swap = first.bitwiseXOR(value).bitwiseAND(low)
            out.append(F.when(set_, value).otherwise(value.bitwiseXOR(swap)))
            first = F.when(set_, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
        return F.struct(*[c.alias(n) for c, n in zip([first, *out], names)])

    turned = F.aggregate(marks, start, turn)
    # Gray coding: each coordinate is combined with the one before it.
    gray, made = [], None
    for n in names:
        made = turned[n] if made is None else made.bitwiseXOR(turned[n])
        gray.append(made)
    point = F.struct(*[c.alias(n) for c, n in zip(gray, names)])
    packed = F.transform(F.array(point), lambda p: p)  # worked out once, used for each bit below

    def index(p: Column) -> Column:
        last = p[names[-1]]
        flip = F.aggregate(
            marks, F.lit(0).cast("long"), lambda t, m: F.when(last.bitwiseAND(m) != 0, t.bitwiseXOR(m - 1)).otherwise(t)
        )

        def place(acc: Column, mark: Column) -> Column:
            for n in names:
                bit = F.when(p[n].bitwiseXOR(acc["flip"]).bitwiseAND(mark) != 0, F.lit(1)).otherwise(F.lit(0))
                acc = F.struct((acc["at"] * 2 + bit).alias("at"), acc["flip"].alias("flip"))
            return acc

        zero = F.struct(F.lit(0).cast("long").alias("at"), flip.alias("flip"))
        return F.aggregate(marks, zero, place, lambda acc: acc["at"])

    return F.transform(packed, index)[0]


def curve_shards(
    df: DataFrame, levels: Mapping[str, Column], shards: int = SHARDS, bits: int = BITS, id_col: str = "doc_id",
    tie: Column | None = None,
) -> DataFrame:
    """All columns plus `curve`, `shard` and `slot`: equal runs of the curve, counts at most one apart.

    Rows at one curve position are ordered by id, then by `tie`, so that a position with any number
    of rows is spread over ranges and shards. The global positions come from sizes of sorted
    ranges; no window holds more than one row per range.
    """
    placed = df.withColumn("curve", hilbert_index(list(levels.values()), bits))
    order = [F.col("curve"), q(id_col), *([tie] if tie is not None else [])]
    ranked = global_index(placed, order, "__at")
    rows = ranked.count()
    if not rows:
        return ranked.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).drop("__at")
    shard = F.expr(f"int(__at * {shards} div {rows})")
    begin = F.expr(f"(shard * {rows}L + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("__at") - begin).drop("__at")


def document_shards(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """`doc_id, size, text_crc32, law, curve, shard, slot, grown_shard` of each row.

    The curve runs over the size of the text, the source and the language. The law is `rows`: shard
    counts differ by one at most, and slots run from 0 in curve order. A missing text has no bytes;
    a missing source or language counts as the empty name, a missing id comes first among
    equals. Repeated rows each get a slot. An empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(q(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        q(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        name_level(q(source_col)).alias("source_level"),
        name_level(q(lang_col)).alias("lang_level"),
    )
    levels = {"source": F.col("source_level"), "size": size_level(F.col("size")), "lang": F.col("lang_level")}
    placed = curve_shards(narrow, levels, shards, BITS, "doc_id", F.col("text_crc32"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "curve", "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _oracle(bits: int = BITS, shards: int = SHARDS) -> str:
    """The same curve in SQL, one select per step; the checksum runs over the bytes by its table."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    level = "('0x' || substr(md5(coalesce({0}, '')), 1, 4))::BIGINT % {1}"
    steps = [
        f"""t AS (SELECT doc_id, coalesce(text, '') AS text, {level.format('source', 1 << bits)} AS x0,
          {level.format('lang', 1 << bits)} AS x2 FROM documents)""",
        "h AS (SELECT *, hex(encode(text)) AS hx FROM t)",
        f"""p0 AS (SELECT doc_id, text, octet_length(encode(text)) + 1 AS size, xor(list_reduce(
          list_prepend(4294967295::BIGINT, list_transform(range(1, length(hx)::BIGINT, 2), lambda i: ('0x' || substr(hx, i, 2))::BIGINT)),
          lambda c, b: xor(c >> 8, ({table}::BIGINT[])[xor(c & 255, b) + 1])), 4294967295) AS text_crc32, x0,
          least(floor(4 * log2((octet_length(encode(text)) + 1)::DOUBLE)), {(1 << bits) - 1})::BIGINT AS x1, x2 FROM h)""",
    ]
    n = 0
    keep = "doc_id, size, text_crc32"
    for b in range(bits - 1, -1, -1):
        m, low = 1 << b, (1 << b) - 1
        steps.append(
            f"p{n + 1} AS (SELECT {keep}, CASE WHEN x0 & {m} != 0 THEN xor(x0, {low}) ELSE x0 END AS x0, x1, x2 FROM p{n})"
        )
        n += 1
        for i in (1, 2):
            others = f"x{3 - i}"
            steps.append(
                f"""p{n + 1} AS (SELECT {keep}, CASE WHEN x{i} & {m} != 0 THEN xor(x0, {low}) ELSE xor(x0, xor(x0, x{i}) & {low}) END AS x0,
                CASE WHEN x{i} & {m} != 0 THEN x{i} ELSE xor(x{i}, xor(x0, x{i}) & {low}) END AS x{i}, {others} FROM p{n})"""
            )
            n += 1
    steps.append(f"g AS (SELECT {keep}, x0, xor(x0, x1) AS x1, xor(xor(x0, x1), x2) AS x2 FROM p{n})")
    flip = "xor(" * (bits - 1) + "0" + "".join(
        f", CASE WHEN x2 & {1 << b} != 0 THEN {(1 << b) - 1} ELSE 0 END)" for b in range(bits - 1, 0, -1)
    )
    steps.append(f"f AS (SELECT *, {flip} AS fl FROM g)")
    places = [f"((xor(x{i}, fl) >> {b}) & 1) * {1 << (3 * b + 2 - i)}" for b in range(bits - 1, -1, -1) for i in range(3)]
    steps.append(f"c AS (SELECT {keep}, {' + '.join(places)} AS curve FROM f)")
    steps.append(
        "r AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id, text_crc32) - 1 AS pos, count(*) OVER () AS n FROM c)"
    )
    return f"""WITH {', '.join(steps)}
SELECT doc_id, size, text_crc32, 'rows' AS law, curve, (pos * {shards} // n)::INT AS shard,
       pos - ((pos * {shards} // n) * n + {shards - 1}) // {shards} AS slot, NULL::INT AS grown_shard FROM r"""


@query("op6_hilbert_shards", _oracle())
def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_shards(read(spark, sf_dir, "documents"))

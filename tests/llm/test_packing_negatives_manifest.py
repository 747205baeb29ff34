"""Packing, hard negatives and the manifest against brute force, the library and odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import merkle, negatives, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tail string, step string, rank string, path string"
WORDS = "red green blue stone river cloud paper light house table 42 Ü 日本 <|endoftext|> don't  ".split(" ")


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Missing values, empty and very long texts, repeated rows and ids, columns with clashing names."""
    rows = [(i, prose(i, 5 * i), "en", f"s{i % 20}", i) for i in range(60)]
    rows += [(100 + i, f"Text {i} ABC", "de", "hot", i) for i in range(300)]
    rows += [
        (2, prose(2, 10), "en", "s2", 2), (2, "other Text, same id", "en", "s2", 2),
        (3, None, None, None, None), (None, None, None, None, None), (None, "", None, "", 0), (None, "A", None, "", 0), (4, "", "en", "s1", 0),
        (5, prose(3, 20_000), "de", "long", 1), (6, "X" * 30_000, "de", "alone", 1), (7, " " * 5_000, None, "s1", None),
    ]
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_files()[0])


def test_both_libraries_agree_below_the_mark(library):
    ids = packing.Ids(*packing.default_files())
    points = [c for c in range(1, packing.PLAIN_BELOW) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2 !{chr(c)}! \n{chr(c)} x'{chr(c)}" for c in points]
    texts += ["a" * 30_000, " \n" * 9_000, "x<|endoftext|> y", "日本 a", "", "\x00"]
    for text, made in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert ids(text).tolist() == made.ids, text[:40]


def check_pieces(rows, texts, library, contexts):
    """Every id lies in one piece of its document, and sequences are gapless and full."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == parts[0]["context"] <= max(contexts) and at & (at - 1) == 0
        assert len({(r["context"], r["step"]) for r in parts}) == 1
    want = Counter()
    for i, text in texts:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want[i] += len(ids)
    have = Counter()
    for r in rows:
        have[r["doc_id"]] += r["length"]
    assert have == want
    return sequences


@pytest.mark.parametrize("contexts", [(128, 256, 512, 1024), (64,)])
def test_packing_of_odd_tables(odd, empty, library, contexts):
    rows = packing.pack_documents(odd.repartition(3), contexts=contexts, step_tokens=4096, keep_ids=True).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_pieces(rows, texts, library, contexts)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and len(r["ids"]) == r["length"]
    for i, n in Counter(i for i, _ in texts).items():
        if n == 1:
            ids = library.encode(dict(texts)[i] or "", add_special_tokens=False).ids + [0]
            mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
            assert [x for r in mine for x in r["ids"]] == ids and {r["doc_tokens"] for r in mine} == {len(ids)}
            assert [r["start"] for r in mine] == [sum(m["length"] for m in mine[:k]) for k in range(len(mine))]
    assert packing.pack_documents(empty, contexts=contexts).count() == 0


def test_sequences_hold_the_ids(odd, library):
    some = odd.filter("doc_id < 40")
    pieces = packing.pack_documents(some, contexts=(32, 128), keep_ids=True)
    made = packing.sequences_of(pieces).collect()
    total = sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in some.collect())
    assert sum(len(r["ids"]) for r in made) == total
    for r in made:
        assert len(r["ids"]) == r["context"] == sum(r["lengths"]) and len(r["doc_ids"]) == len(r["lengths"])


def test_plan_places_every_tail_once():
    rnd = random.Random(7)
    for trial in range(60):
        longest = 1 << rnd.randint(3, 6)
        contexts = [longest >> k for k in range(rnd.randint(1, 3))]
        tails = {rnd.randrange(1, longest): rnd.randint(1, 40) for _ in range(rnd.randint(1, 9))}
        plan = packing.plan_windows(tails, contexts)
        lookup = packing.Lookup(plan, 5, longest, 2 * longest)
        filled, steps = defaultdict(list), defaultdict(Counter)
        for n, count in tails.items():
            for rank in range(count):
                at = 0
                for start, size, sequence, offset, context, step in lookup.tail(n, rank):
                    assert start == at
                    at += size
                    filled[sequence].append((offset, size, context, step))
                assert at == n
        assert len(filled) == plan.sequences
        for parts in filled.values():
            at = 0
            for offset, size, context, step in sorted(parts):
                assert offset == at
                at += size
            assert at == context
            steps[context][step] += 1
        for k in range(5):
            _, context, step = lookup.whole(k)
            steps[context][step] += 1
        for counts in steps.values():
            assert max(counts.values()) - min(counts.values()) <= 1
        named = [s for counts in steps.values() for s in counts]
        assert len(named) == len(set(named))


def test_plan_does_not_grow_with_the_number_of_tails():
    rnd = random.Random(3)
    for lengths in (range(1, 1024), range(600, 601), range(513, 1024), range(1, 40)):
        shape = {n: rnd.randint(1, 1000) for n in lengths}
        few = packing.plan_windows(shape)
        many = packing.plan_windows({n: c * 10**6 for n, c in shape.items()})
        pieces = [sum(map(len, p.pieces.values())) for p in (few, many)]
        assert pieces[1] < 3 * pieces[0] + 200 and pieces[1] < 20_000


def test_tails_of_their_own_context_are_not_cut_while_others_fit():
    plan = packing.plan_windows({700: 10, 324: 10})
    assert sum(map(len, plan.pieces.values())) == 2 and plan.sequences == 10


def test_residue_products_are_exact():
    rnd = np.random.default_rng(5)
    for width, size in ((1, 3), (64, 256), (700, 40_000), (64, 10**8), (5, 2 * 10**8)):
        left = rnd.integers(-size, size + 1, (7, width))
        right = rnd.integers(-size, size + 1, (9, width))
        left[0], right[0], right[1] = size, size, -size
        primes = negatives.primes_for(width, width * size * size)
        half = primes[0] // 2
        assert min(width, negatives.DEPTH) * half * half <= 1 << 24
        want = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in right] for x in left]
        got = negatives.products(negatives.residues(left, primes), negatives.residues(right, primes), primes)
        assert got.tolist() == want


def brute_negatives(rows, positives, negs, low, high):
    plain = []
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        plain.append((i, label, [math.floor(256 * x) for x in vector]))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, label, v) in enumerate(plain):
        if i % 100:
            continue
        scored = sorted((-score(v, w), j, m, k) for k, (j, m, w) in enumerate(plain) if k != n)
        for s, p, *_ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and low * -s <= -x[0] <= high * -s][:negs]
            out += [(i, p, r, x[1], -s, -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4_096, 3])
def test_hard_negatives_by_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(negatives, "TILE", 500)
    rnd = random.Random(11)
    rows = [(i, rnd.randrange(3), [rnd.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(0, 700, 2)]
    rows += [(i, 1, [0.5, 0.5, 0.5, 0.5]) for i in range(1, 300, 2)]  # many equal vectors
    rows += [(100, 1, [1.0, 1.0]), (700, 0, [0.5]), (700, 0, [0.5]), (None, 0, [1.0]), (800, None, [1.0]), (900, 1, None)]
    rows += [(1000, 1, [float("nan"), 1.0]), (1100, 1, [float("inf")]), (1200, 2, [None, 1.0]), (1300, 2, []), (1400, 2, [0.1, -0.7, 0.3, 9.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, rank string, score int")
    got = negatives.hard_negatives(df.repartition(3), F.col("vec_id") % 100 == 0, block_anchors=block)
    have = sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    want = brute_negatives(rows, 5, 10, negatives.Fraction(3, 10), negatives.Fraction(9, 10))
    assert have == want and len(want) > 200


def test_hard_negatives_of_empty_tables(spark):
    kind = "vec_id long, label int, embedding array<float>"
    none = spark.createDataFrame([], kind)
    assert negatives.hard_negatives(none, F.col("vec_id") % 100 == 0).count() == 0
    lone = spark.createDataFrame([(100, 1, [1.0]), (3, None, [1.0])], kind)
    assert negatives.hard_negatives(lone, F.col("vec_id") % 100 == 0).count() == 0
    huge = spark.createDataFrame([(100, 1, [1e30]), (3, 1, [1.0])], kind)
    with pytest.raises(ValueError):
        negatives.hard_negatives(huge, F.col("vec_id") % 100 == 0)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sealed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes, fanout):
    """Root, and the siblings of each node as (left, right) per level."""
    paths = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for k in range(len(run)):
                for o in owners[at + k]:
                    paths[o].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(digest(*run))
            held.append([o for k in range(len(run)) for o in owners[at + k]])
        nodes, owners = above, held
    return nodes[0], paths


def brute_manifest(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        now = dict(r.asDict())
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
            now["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
        leaf, changed = (digest(*[sealed(x[f]) for f in merkle.FIELDS]) for x in (r, now))
        groups[r["source"]].append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf), r["doc_id"], leaf, changed))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[0])], fanout) for s in order}
    root, tops = tree([below[s][0] for s in order], fanout)
    out = []
    for s, top in zip(order, tops):
        for (_, i, leaf, changed), path in zip(sorted(groups[s], key=lambda x: x[0]), below[s][1]):
            folded = changed
            for left, right in path + top:
                folded = digest(left, folded, right)
            out.append((i, leaf, below[s][0], root, digest(*[x for p in path + top for x in p]), folded, folded == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("fanout", [16, 2])
def test_manifest_by_brute_force(odd, fanout):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.manifest(odd.repartition(3), tampered=hit, fanout=fanout).select(*COLUMNS).collect()
    want = brute_manifest(odd.collect(), fanout)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert 0 < sum(not r[-1] for r in want) < len(want) / 3


def test_manifest_of_few_rows(spark, empty):
    assert merkle.manifest(empty).count() == 0
    one = spark.createDataFrame([(1, "Text", "en", None, 4)], "doc_id long, text string, lang string, source string, n_chars long")
    row = merkle.manifest(one, tampered=F.lit(True)).first()
    assert row["leaf"] == row["subroot"] == row["root"] != row["folded_root"] and not row["verified"]
    assert row["proof_sha256"] == hashlib.sha256(b"").hexdigest()

"""The training-data operators against brute force, libraries and odd tables."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm import decontamination as D
from tidewright.llm import hilbert, licences, piece_bpe, pseudo_lm, simhash, token_counts, toxicity, url_rules
from tidewright.llm.common import texts_of
from tidewright.llm.components import connected_components
from tidewright.llm.exact_dedup import MisraGries, exact_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, group int, row string"
WORDS = "red green blue stone river cloud paper light house table".split()


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "s", "ed"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Missing values, empty and very long texts, repeated rows and ids, columns with clashing names."""
    rows = [
        (1, prose(1, 40), "en", "a", 1, 0, "x"),
        (2, prose(1, 40), "en", "a", 1, 0, "x"),
        (2, prose(1, 40), "en", "a", 1, 0, "x"),
        (3, None, None, None, None, None, None),
        (4, "", "en", "a", 0, 0, "x"),
        (None, prose(2, 30), None, "b", 1, 1, None),
        (None, "", None, "b", 1, 1, None),
        (5, prose(3, 20_000), "de", "b", 1, 1, "y"),
        (6, "x" * 50_000, "de", "b", 1, 1, "y"),
        (7, prose(1, 40).replace(" ", "\n\t "), "en", "a", 1, 0, "x"),
        (2, prose(9, 12), "en", "a", 1, 0, "other text, same id"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup_by_brute_force(odd, empty):
    rows = exact_dedup(odd, counters=2).collect()
    plain = [(r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in odd.collect()]
    groups = defaultdict(list)
    for i, t in plain:
        groups[hashlib.sha256(t.encode()).hexdigest()].append(i)
    assert len(rows) == len(plain)
    for r in rows:
        ids = groups[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["keep_id"] == (min(known) if known else None) and r["group_size"] == len(ids)
    assert Counter(r["text_sha256"] for r in rows if r["kept"]) == Counter(groups.keys())
    assert exact_dedup(empty).count() == 0


def test_misra_gries_keeps_frequent_keys():
    import pandas as pd

    keys = ["hot"] * 400 + [f"k{i}" for i in range(600)]
    random.Random(5).shuffle(keys)
    summary = MisraGries(10)
    for at in range(0, 1000, 100):
        summary.add(pd.Series(keys[at : at + 100]))
    assert len(summary.held) <= 10 and 300 <= summary.held["hot"] <= 400


def slow_fingerprint(text):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not parts:
        return 0
    grams = [" ".join(parts[i : i + 3]) for i in range(len(parts) - 2)] or [" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in ["", " \n", "One", "Ä B", "a b\x0bc d", prose(4, 50), "ÉA a a a a a"]:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == slow_fingerprint(text)


def brute_components(values):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("trie_rows", [50_000, 40])
def test_trie_join_finds_every_link(spark, trie_rows):
    rnd = random.Random(3)
    values = {rnd.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(5):
            for _ in range(rnd.randint(1, 5)):
                v ^= 1 << rnd.randrange(64)
            values.add(v)
    near = rnd.getrandbits(64)  # a dense group in one trie
    values |= {near ^ sum(1 << b for b in rnd.sample(range(20), 3)) for _ in range(150)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), trie_rows)
    found = {r["node"]: r["component"] for r in connected_components(links, "a", "b").collect()}
    want = brute_components(values)
    assert len(set(want)) < len(values)
    pairs = {}
    for v, w in zip(signed, want):
        assert pairs.setdefault(w, found.get(v, v)) == found.get(v, v)
    assert len({found.get(v, v) for v in signed}) == len(set(want))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1100)}


def test_simhash_groups_of_odd_tables(odd, empty):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == odd.count()
    empties = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(empties) == 3 and {r["component_id"] for r in empties} == {3}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 7)} == {1}
    assert simhash.simhash_groups(empty).count() == 0


def shingle_set(text):
    parts = text.lower().split()
    return {" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))}


@pytest.mark.parametrize("trie_rows", [50_000, 8])
def test_similar_groups_match_set_similarity(spark, trie_rows):
    """Pairs clearly above 0.8 share a group, and no group joins texts that are clearly below it by all links."""
    rnd = random.Random(8)
    texts = []
    for base in range(12):
        start = prose(200 + base, 220).split()
        for edits in (0, 1, 1, 2, 3, 12, 30):
            words = list(start)
            for at in rnd.sample(range(len(words)), edits):
                words[at] = f"changed{rnd.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += ["two words", "two  WORDS", "four words are here", "four words are there", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs, trie_rows=trie_rows).collect()}
    sets = [shingle_set(t) for t in texts]
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(texts)) for j in range(i)}
    assert sum(s >= 0.87 for s in alike.values()) > 50
    assert all(group[i] == group[j] for (i, j), s in alike.items() if s >= 0.87)
    for i in range(len(texts)):
        near = [s for pair, s in alike.items() if i in pair]
        if max(near) < 0.65:
            assert group[i] == i


def test_dense_group_of_signatures_is_one_component():
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 2, 512, dtype=np.uint8)
    bits = np.repeat(base[None], 4000, axis=0)
    bits[:, simhash.RUN :] ^= (rnd.random((4000, 512 - simhash.RUN)) < 0.05).astype(np.uint8)
    keys = np.packbits(bits, axis=1).view(">u8").astype(np.uint64)
    budget = simhash.error_budget(0.8)
    order, label = simhash.trie_components(np.zeros(4000, dtype=np.int64), keys, simhash.RUN, budget.__getitem__, 1 << 15, 1024)
    assert sorted(order) == list(range(4000)) and not label.any()


def test_similar_groups_of_odd_tables(odd, empty):
    rows = simhash.similar_groups(odd).collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 7)} == {1}
    assert simhash.similar_groups(empty).count() == 0
    assert simhash.signature("") == bytes(64)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())


def test_pieces_equal_the_library(library):
    codec = piece_bpe.codec(piece_bpe.default_model())
    rnd = random.Random(1)
    alphabets = ["abcdeth inorsALK,.é日本語😀\t\n\x00▁  <>0x123'\"ﬁ́", "aab  een", " \n="]
    texts = ["", " ", "\n", "<s> </s> <unk> <0x41>", "a" * 20_000, prose(6, 500)]
    texts += ["".join(rnd.choice(a) for _ in range(rnd.randint(0, 50))) for a in alphabets for _ in range(1500)]
    for t in texts:
        want = library.encode(t)
        assert codec.encode(t) == want and codec.decode(want) == library.decode(want)
        back = library.decode(want)
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, want)), back)]
        assert codec.digest(t) == (len(want), *sums)
        assert sum(token_counts.length_of(library, u) for u in piece_bpe.units_of(t)) == len(want)


def test_adjacent_pieces_as_by_merging():
    model = piece_bpe.codec(piece_bpe.default_model()).model
    rnd = random.Random(8)
    ids = rnd.sample(sorted(model.ids.values()), 300)
    for a, b in zip(ids, ids[1:]):
        assert model.fits(a, b) == (model.merge(model.pieces[a] + model.pieces[b]) == [model.pieces[a], model.pieces[b]])


def test_token_counts_and_round_trip(odd, empty, library):
    texts = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    counted = token_counts.token_counts(odd, limit=100, table_units=5).collect()
    want = Counter((i, len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 100) for i, t in texts)
    assert Counter(map(tuple, counted)) == want
    encoded = piece_bpe.encode_texts(odd)
    assert Counter((i, tuple(ids)) for i, ids in encoded.collect()) == Counter((i, tuple(library.encode(t))) for i, t in texts)
    assert Counter(map(tuple, piece_bpe.decode_ids(encoded).collect())) == Counter(texts)
    assert piece_bpe.round_trip(odd).count() == len(texts)
    assert token_counts.token_counts(empty).count() == piece_bpe.round_trip(empty).count() == 0


def test_hilbert_curve_is_continuous(spark):
    for dims, bits in ((2, 4), (3, 3)):
        axes = np.meshgrid(*[np.arange(1 << bits)] * dims)
        points = [tuple(int(v) for v in p) for p in zip(*[a.ravel() for a in axes])]
        names = [f"c{i}" for i in range(dims)]
        df = spark.createDataFrame(points, ", ".join(f"{n} long" for n in names))
        rows = df.withColumn("at", hilbert.hilbert_index([F.col(n) for n in names], bits)).collect()
        line = sorted((r["at"], tuple(r[n] for n in names)) for r in rows)
        assert [a for a, _ in line] == list(range(len(points)))
        assert all(sum(abs(x - y) for x, y in zip(p, q)) == 1 for (_, p), (_, q) in zip(line, line[1:]))


def test_shards_of_odd_tables(odd, empty):
    rows = hilbert.document_shards(odd, shards=4).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == odd.count()
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert hilbert.document_shards(empty).count() == 0


def test_shards_prune_by_their_bounds(spark):
    df = spark.range(4096).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 7919 % 500).cast("int")).alias("text"),
        F.lit("en").alias("lang"), (F.col("id") * 31 % 40).cast("string").alias("source"),
    )
    placed = hilbert.document_shards(df).groupBy("shard").agg(F.min("size").alias("a"), F.max("size").alias("b")).collect()
    assert sum(r["a"] <= 20 <= r["b"] for r in placed) < 12


def test_url_parts_and_rules(spark):
    urls = [
        "HTTP://A.Example.NET/en/1?q=/x", "https://example.com/de/2#top", "http://x.org/fr/3", "http://x.org/de/4", "http://sub.net",
        "http://sub.net/", "http://notnet/", "no scheme", None, "", "x://h?p://q/r", "http://example.com.org/fr/9", "http://ÀB.net/" + "y" * 50_000,
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_rules.judge_urls(pages, labels).collect()}
    assert [got[0][k] for k in ("host", "path", "rule", "verdict")] == ["a.example.net", "/en/1", "example.net/en/", "allow"]
    assert [got[i]["rule"] for i in range(1, 12)] == ["example.com/de/", "org/fr/", None, None, "net/", None, None, None, None, None, "org/fr/"]
    assert got[4]["path"] == "" and got[7]["host"] == got[8]["host"] == "" and got[10]["host"] == "h"
    assert got[12]["host"] == "Àb.net" and got[12]["verdict"] == "block" and got[8]["verdict"] == "allow"
    assert url_rules.judge_urls(pages.limit(0), labels).count() == 0


def test_mined_rules_block_by_token_sets(spark):
    pages = spark.createDataFrame(
        [(i, f"http://h{i % 3}.org/{'spam' if i % 2 else 'ok'}/{i}?ref=x", "") for i in range(120)], "page_id long, url string, html string"
    )
    labels = spark.createDataFrame([(i, 0 if i % 2 and i % 3 == 0 else 1, None) for i in range(100)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(pages, labels, min_confidence=0.9).collect()}
    assert got == {i: "block" if i % 2 and i % 3 == 0 else "allow" for i in range(120)}


def brute_rules(rows):
    """All rules of any length: tokens to support and confidence, by listing every subset of every row."""
    n, hit = Counter(), Counter()
    for tokens, blocked in rows:
        for k in range(1, len(tokens) + 1):
            for items in itertools.combinations(sorted(tokens), k):
                n[items] += 1
                hit[items] += blocked
    base = sum(b for _, b in rows) / len(rows)
    least = max(5, 0.005 * len(rows))
    return {i: (hit[i], hit[i] / n[i]) for i in n if hit[i] >= least and hit[i] / n[i] >= 0.5 and hit[i] / n[i] / base >= 1.2}


def best_by_brute_force(marked):
    """The confidence of the surest of all rules that fits each row."""
    want = brute_rules([(r["tokens"], r["blocked"]) for r in marked if r["blocked"] is not None])
    return {r["page_id"]: max((c for i, (_, c) in want.items() if set(i) <= set(r["tokens"])), default=None) for r in marked}


def paths(words):
    return [(i, f"http://h.org/{i}/{'-'.join(w)}", "") for i, w in enumerate(words)]


@pytest.mark.parametrize("most", [14, 0])
def test_mined_rules_of_any_length_by_brute_force(spark, most):
    """Four words block together and three do not; other rows share words by chance, and pages without a label have parts of them."""
    rnd = random.Random(8)
    words = [["aa", "bb", "cc", "dd"]] * 10 + [list(w) for w in itertools.combinations(["aa", "bb", "cc", "dd"], 3)] * 12
    words += [sorted(rnd.sample(["ee", "ff", "gg", "hh", "ii", "aa"], rnd.randint(1, 5))) for _ in range(60)]
    words += [["kk", "ll", "mm"]] * 6  # always together: any one of them is enough
    blocked = [len(w) == 4 and w[0] == "aa" and w[-1] == "dd" or "ff" in w and "gg" in w and rnd.random() < 0.8 or w[0] == "kk" for w in words]
    size = len(words)
    words += [["kk"], ["ll", "aa"], ["mm", "nn"], ["ff", "gg"], ["ff"], ["gg", "ff", "ee"], []]
    pages = spark.createDataFrame(paths(words), "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(blocked)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_rules.judge_urls(pages, labels, most_groups=most).collect()}
    marked = pages.select("page_id", url_rules.url_tokens(F.col("url")).alias("tokens"))
    marked = marked.withColumn("blocked", F.when(F.col("page_id") < size, F.element_at(F.array(*[F.lit(b) for b in [*blocked, *[False] * 7]]), F.col("page_id").cast("int") + 1)))
    want = best_by_brute_force(marked.collect())
    assert {i: r["confidence"] and round(r["confidence"], 9) for i, r in got.items()} == {i: c and round(c, 9) for i, c in want.items()}
    assert {want[size + k] is not None for k in range(3)} == {True} and want[size + 4] is None


@pytest.mark.parametrize("nested", [False, True])
def test_forty_shared_tokens(spark, nested):
    """Ten of sixty rows share a long path; or every row has the beginning of one."""
    long = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    words = [long[: 40 if i < 10 else 5 + i % 33] if nested else long if i < 10 else [f"x{chr(97 + i % 26)}"] for i in range(60)]
    pages = spark.createDataFrame([*paths(words), (900, "http://h.org/900/" + long[39], ""), (901, "http://other.com/901", "")], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, 1, int(i < 10)) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(pages, labels).collect()}
    assert got == {**{i: "block" if i < 10 else got[i] for i in range(60)}, 900: "block", 901: "allow"}
    assert nested or all(got[i] == "allow" for i in range(10, 60))


def test_toxicity_learns_folds_and_exempts(spark, empty, odd):
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        # One stem with changing ends stands for words that no seed names.
        rows.append((i, prose(i, 30) + (f" zgurb{'abcdefgh'[i % 8]}{'xyz'[i % 3]}" if bad else ""), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", F.lit(1).alias("quality"), "toxic")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["predicted"] == r["toxic"] for r in held)
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " scum": 2.0})
    assert len(lexicon.hits(toxicity.fold("You 1D10T and scumbag, ｉdiоt!"))) == 3
    assert not lexicon.hits(toxicity.fold("scum idiotic")) and toxicity.fold("") == " "
    assert not toxicity.Lexicon({" trash ": 3.0}).hits(toxicity.fold("Empty the trash can."))
    scored = toxicity.score_toxicity(odd, lexicon).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] < 0.3 for r in scored)
    assert toxicity.toxicity(empty, labels.limit(0)).count() == 0


QUESTION = "If Anna walks 12 miles and then Peter walks 30 miles, how many miles did Anna and Peter walk in all on that day?"
OTHER_VALUES = QUESTION.replace("Anna", "Maria").replace("Peter", "John").replace("12 miles", "7 km").replace("30 miles", "44 km")
MIXED_UP = QUESTION.replace("Anna and Peter walk", "Zoe and Bob walk").replace("Peter walks", "Ken walks")


def test_decontamination_kinds(spark, empty, odd):
    docs = spark.createDataFrame(
        [(1, f"{prose(1, 20)} {QUESTION} {prose(2, 20)}"), (2, f"{prose(3, 20)}. {OTHER_VALUES}"), (3, prose(5, 200)), (4, None), (5, MIXED_UP),
         (6, QUESTION.upper()), (1, QUESTION)],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(9, QUESTION), (10, None), (None, "x y z"), (11, "..."), (12, QUESTION)], "item_id long, text string")
    rows = D.contaminations(docs, items, consistent=0.9, block_items=1).collect()
    kinds = Counter((r["doc_id"], r["item_id"], r["kind"]) for r in rows)
    assert kinds[1, 9, "verbatim"] == kinds[1, 12, "verbatim"] == 2
    assert kinds[2, 9, "reparameterised"] == 1
    assert not any(k[0] in (3, 4, 5) or k[1] in (None, 10, 11) for k in kinds)
    assert D.contaminations(empty, items).count() == D.contaminations(odd, items.limit(0)).count() == 0
    clean = D.drop_contaminated(docs.withColumn("extra", F.lit(1)), items, block_items=2)
    assert clean.columns == ["doc_id", "text", "extra"] and {3, 4} <= {r["doc_id"] for r in clean.collect()}
    assert not {1, 2} & {r["doc_id"] for r in clean.collect()}


def test_decontamination_of_names_that_begin_sentences(spark):
    asked = [
        ("Tom has 5 apples. Mary has 3 apples. How many apples do Tom and Mary have together?", [("Tom", "Sam"), ("Mary", "Lisa"), ("5", "7"), ("3", "4")]),
        ("John walks 12 miles. Anna walks 30 miles. John then rests. How many miles did they walk in all on that day?",
         [("John", "Peter"), ("Anna", "Maria"), ("12", "9"), ("30", "41")]),
        ("Tom has 6 red pens. Later on that day Tom lost some of them. How many pens does Tom Smith have?", [("Tom Smith", "Lisa"), ("Tom", "Lisa"), ("6", "8")]),
        ("Rome is old.", []),
        ("Hello.", []),
    ]
    docs = []
    for i, (text, pairs) in enumerate(asked[:3]):
        other = text
        for a, b in pairs:
            other = other.replace(a, b)
        docs += [(10 * i, f"{prose(i, 20)}. {text} {prose(i + 9, 9)}"), (10 * i + 1, f"{prose(i, 20)}. {other} {prose(i + 9, 9)}"), (10 * i + 2, f"{prose(i, 20)} {other}")]
    mixed = "Sam has 7 apples. Lisa has 4 apples. How many apples do Zoe and Bob have together?"
    docs += [(90, mixed), (91, "They met Paul and Anna. Then Paul left.")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(asked)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in D.contaminations(docs, items).collect()}
    assert got == {(10 * i + k, i): "verbatim" if not k else "reparameterised" for i in range(3) for k in range(3)}


def brute_items(text, items):
    """Every item against every place of the text, plain and with folded names."""
    want = set()
    for read_ in (D.Text.of(text), D.Text.folded(text)):
        for item in items if read_ else []:
            share, agree, _, _ = D.compare(item, read_, set(range(-len(item.words), len(read_.low) + 1)))
            if share >= D.SHARE - 1e-12 and agree >= D.CONSISTENT:
                want.add(item.item_id)
    return want


def test_decontamination_index_loses_nothing():
    rnd = random.Random(4)
    cast = ["Tom", "Anna Maria", "Peter", "USA"]
    parts = [*WORDS, "5", "twelve", "miles", "km", "Tom", "Anna", "the", "."]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(60)]
    texts += [". ".join(f"{rnd.choice(cast)} {prose(9 * i + k, rnd.randint(2, 5))}" for k in range(4)) for i in range(30)]
    items = [v for i, t in enumerate(texts) for v in D.Item.both(i, t) if v.words]
    index = D.anchors(items)
    hits = 0
    for k in range(120):
        chosen = rnd.sample(texts, 2)
        words = f"{prose(k, 10)} {chosen[0]} {prose(k + 99, 3)} {chosen[1]}".split()
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = rnd.choice(["changed", "Zoe", "Tom Smith", "7"])
        text = " ".join(words)
        text = rnd.choice([str, str, str.lower, str.upper, str.title])(text)
        want = brute_items(text, items)
        hits += len(want)
        assert {h[0] for h in D.find_items(text, index)} == want
    assert hits > 120


FORMS = [
    ("If Anna walks 12 miles and then Peter walks 30 miles, how many miles did Anna and Peter walk in all on that day?", None),
    ("A train covers 60 miles in two hours. How many miles in one hour does the train cover on its way to Rome?",
     "A train covers 90 km in three hours. How many km in one hour does the train cover on its way to Rome?"),
    ("Tom O'Neil of the USA has five apples. Mary has three apples. How many apples do Tom O'Neil and Mary have together?",
     "TOM O'BRIEN of the UK has 7 apples. LISA has twelve apples. How many apples do TOM O'BRIEN and LISA have together?"),
    ("The NASA probe sent 14 pictures of Mars to Anna before it was lost behind the large grey moon.",
     "The ESA probe sent 250 pictures of Venus to Zoe before it was lost behind the large grey moon."),
]


@pytest.mark.parametrize("number", range(len(FORMS)))
def test_decontamination_in_any_case_and_with_number_words(number):
    text, other = FORMS[number]
    items = [v for i, (t, _) in enumerate(FORMS) for v in D.Item.both(i, t)]
    index = D.anchors(items)
    for k, case in enumerate((str, str.lower, str.upper, str.title, str.swapcase, str.capitalize)):
        got = D.find_items(f"{prose(k, 30)}. {case(text)} {prose(k + 50, 30)}", index)
        assert [h[0] for h in got] == [number] and (got[0][3] == 0 or case in (str.title, str.swapcase))
    if other:
        for case in (str, str.upper):
            got = D.find_items(f"{prose(1, 30)}. {case(other)} {prose(2, 30)}", index)
            assert [h[0] for h in got] == [number] and got[0][3] > 0
    assert D.find_items(prose(7, 400), index) == []


def test_decontamination_of_missing_ids(spark):
    docs = spark.createDataFrame([(None, QUESTION), (None, QUESTION), (3, ""), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, QUESTION), (9, QUESTION)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in D.contaminations(docs, items).collect()] == [(None, 9)] * 2
    assert [r["doc_id"] for r in D.drop_contaminated(docs, items).collect()] == [3, 3]


def test_licence_families_and_unknown(spark, odd, empty):
    lines = [s for many in licences.TEMPLATES.values() for s in many]
    families = [f for f, many in licences.TEMPLATES.items() for _ in many]
    other = ["A driving license is needed to rent a van.", "The general public was asked.", prose(3, 30), "", "Apache pilots met at MIT.",
             "I lost my license last year, but version 3 of the form is public.", "The lesser general was in the free foundation."]
    text = "\n\n".join(lines + other)
    rows = licences.scan_licences(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    found = defaultdict(list)
    for r in rows:
        found[r["paragraph"]].append(r)
    assert [[r["family"] for r in found[i]] for i in range(len(lines))] == [[f] for f in families]
    assert all(found[i][0]["confirmed"] and found[i][0]["likeness"] == 1.0 for i in range(len(lines)))
    assert not [found[i] for i in range(len(lines), len(lines) + len(other)) if i in found]
    assert licences.scan_licences(odd).count() == licences.scan_licences(empty).count() == 0


MIT_TEXT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
GPL_TEXT = """This file is part of Something.

Something is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
APACHE_TEXT = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""


def commented(text, sign):
    if sign == "/*":
        return "/*\n" + "\n".join(f" * {line}".rstrip() for line in text.split("\n")) + "\n */"
    return "\n".join(f"{sign}{line}".rstrip() for line in text.split("\n"))


def test_licence_texts_wrapped_and_in_comments(spark):
    texts = {
        "mit": MIT_TEXT, "gpl-3.0": GPL_TEXT.format(":", ",", 3), "gpl-2.0": GPL_TEXT.format(";", ";", 2), "bsd": BSD_TEXT, "apache-2.0": APACHE_TEXT,
    }
    rows = [(f"{family}{sign}", f"{prose(1, 30)}\n\n{commented(text, sign)}\n\n{prose(2, 30)}", "x") for family, text in texts.items() for sign in ("", "# ", "// ", "/*")]
    rows += [
        ("dual", "You may use it under either of Apache License, Version 2.0 or MIT license at your option.", "x"),
        ("spdx", "SPDX-License-Identifier: MIT OR Apache-2.0", "x"),
        (None, "Released under the MIT License.", "x"), (None, "Released under the MIT License.", "x"),
    ]
    got = defaultdict(Counter)
    docs = spark.createDataFrame(rows, "doc_id string, text string, family string")
    for r in licences.scan_licences(docs.withColumn("row", F.lit(1))).collect():
        assert r["confirmed"]
        got[r["doc_id"]][r["family"]] += 1
    for family in texts:
        for sign in ("", "# ", "// ", "/*"):
            assert set(got[f"{family}{sign}"]) == {family}, (family, sign)
    assert got["mit"]["mit"] == 3 and got["bsd"]["bsd"] == 3 and got["apache-2.0"]["apache-2.0"] == 2
    assert set(got["dual"]) == set(got["spdx"]) == {"mit", "apache-2.0"} and got[None] == {"mit": 2}


def test_licence_scan_equals_a_plain_one(spark):
    """The same model and rules word by word in Python."""
    model = licences.train(spark)
    stop, telling = set(licences.STOP), lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w and w not in stop]  # noqa: F841

    def grams(t):
        words = telling(t)
        return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}

    def sentences(p):
        name = r"(?:the )?(?:mit|apache|bsd|gpl|lgpl|gnu|mpl|mozilla|cc0|cc|creative)\b"
        return [s for part in re.split(r'(?<=[.!?])\s+(?=[A-ZÄÖÜ"(\[])', p) for s in re.split(rf"(?i)\s+(?:or|and)\s+(?={name})|[/|]\s*(?={name})", part)]

    def judge(p):
        best, held = {}, set()
        for s in sentences(p):
            known = [g for g in grams(s) if g in model.weights]
            held.update(known)
            if not known:
                continue
            z = [(b + sum(model.weights[g][k] for g in known)) / model.temperature for k, b in enumerate(model.bias)]
            odds = np.exp(np.array(z) - max(z))
            chance = odds[:-1] / odds.sum()
            if chance.max() >= model.threshold:
                family = model.families[int(chance.argmax())]
                best[family] = max(best.get(family, 0), float(chance.max()))
        rows = []
        for family, p_ in best.items():
            own = [set().union(*map(grams, sentences(t))) for t in licences.TEMPLATES[family]]
            rows.append((max(len(o & held) / len(o) for o in own) >= licences.LIKENESS, p_, family))
        top = max(rows, default=None)
        return {(f, round(p_, 6), c) for c, p_, f in rows if c or not top[0] and p_ >= licences.SURE and f == top[2]}

    texts = [s for many in licences.HELD_OUT.values() for s in many] + [" ".join(licences.OTHER), MIT_TEXT.replace("\n", " "), prose(4, 60)]
    rnd = random.Random(3)
    for _ in range(40):
        words = " ".join(rnd.sample(texts, 2)).split()
        texts.append(" ".join(w for w in words if rnd.random() < 0.85))
    got = defaultdict(set)
    for r in licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r["doc_id"]].add((r["family"], round(r["probability"], 6), r["confirmed"]))
    assert dict(got) == {i: found for i, t in enumerate(texts) if (found := judge(re.sub(r"\s+", " ", t)))}
    held = [(f, s) for f, many in licences.HELD_OUT.items() if f != licences.UNKNOWN for s in many]
    found = [f in {g[0] for g in judge(s)} for f, s in held]
    assert sum(found) >= 0.7 * len(held)
    assert not [s for s in licences.HELD_OUT[licences.UNKNOWN] if judge(s)]


def test_pseudo_likelihood_prefers_what_it_learned(spark, odd, empty):
    docs = spark.createDataFrame([(i, prose(i, 300)) for i in range(40)] + [(99, "qzx jvk wqz xjq vzk " * 60)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudo_lm.pseudo_likelihood(docs).collect()}
    assert all(got[i]["n_bytes"] == len(prose(i, 300)) for i in range(40))
    assert max(got[i]["mean_log_probability"] for i in range(40)) < 0
    assert got[99]["mean_log_probability"] < min(got[i]["mean_log_probability"] for i in range(40))
    rows = pseudo_lm.pseudo_likelihood(odd, rounds=1).collect()
    assert len(rows) == odd.count() and all(r["mean_log_probability"] is None for r in rows if not r["n_bytes"])
    assert pseudo_lm.pseudo_likelihood(empty).count() == 0


def test_windows_and_scores_by_brute_force(spark):
    texts = ["héllo", "", "a", prose(2, 50)]
    counts = Counter()
    for t in texts:
        b = b"\xff\xff" + t.encode() + b"\xff\xff"
        for i in range(2, len(b) - 2):
            counts[b[i] | b[i - 2] << 8 | b[i - 1] << 16 | b[i + 1] << 24 | b[i + 2] << 32] += 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(map(tuple, pseudo_lm.window_counts(texts_of(df)).collect())) == dict(counts)
    network, losses = pseudo_lm.train(pseudo_lm.window_counts(texts_of(df)), rounds=3)
    assert losses[-1] < losses[0]
    for r in pseudo_lm.score_texts(texts_of(df), network).collect():
        b = b"\xff\xff" + texts[r["doc_id"]].encode() + b"\xff\xff"
        codes = np.array([b[i] | b[i - 2] << 8 | b[i - 1] << 16 | b[i + 1] << 24 | b[i + 2] << 32 for i in range(2, len(b) - 2)], dtype=np.int64)
        assert abs(r["log_probability"] - network.log_probability(codes).sum()) < 1e-4


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables with a toxic text, copies, near copies and a benchmark passage."""
    at = str(tmp_path_factory.mktemp("corpus"))
    long = prose(100, 4000)
    rows = [(i, prose(i, 60), "en", "s", 1) for i in range(20)]
    rows += [(20, prose(3, 60).replace(" ", "  "), "en", "s", 1), (21, long, "en", "s", 1), (22, long + " end", None, None, None)]
    rows += [(23, "you idiot moron scum", "en", "s", 1), (24, f"{prose(7, 9)} {QUESTION}", "en", "s", 1), (25, None, "en", "s", 1), (5, prose(5, 60), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_pipeline_stages_take_effect(spark, corpus, library):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    gone = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, corpus)
        assert after.columns == docs.columns
        left = Counter(r["doc_id"] for r in after.collect())
        gone.append(Counter(r["doc_id"] for r in docs.collect()) - left)
        docs = after
    assert gone == [Counter([23]), Counter([20, 5]), Counter([22]), Counter([24])]
    rows = corpus_pipeline.run(spark, corpus).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(library.encode(t)) for i, t in texts.items()}


def test_pipeline_of_odd_and_empty_documents(spark, odd, empty, corpus):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, corpus)
        ids = [r["doc_id"] for r in docs.collect()]
        assert len(ids) <= odd.count()
    kept = corpus_pipeline.drop_copies(spark, odd, corpus).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(
        [(False, 1), (False, 2), (False, 3), (True, 0), (False, 5), (False, 6)]
    )


def test_near_copies_keep_one_row_of_each_group(spark, corpus):
    """Groups of missing ids alone and groups that share an id stay apart; of each the smallest id stays."""
    near = prose(500, 300)
    rows = [(None, prose(501, 60)), (None, prose(502, 60)), (None, None), (7, prose(503, 60)), (7, prose(504, 60)), (7, prose(505, 60))]
    copies = [(None, near), (9, f"{near} end"), (8, f"start {near}"), (None, f"{near} stop")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows + copies], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, corpus).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter(rows + [(8, f"start {near}")])


def test_components_of_a_hub_and_a_path(spark):
    """A node that holds most links, a long path and a lone pair; the large lookups give the same."""
    hub = [(0, i) for i in range(1, 4_000)]
    path = [(10_000 + i, 10_001 + i) for i in range(60)]
    links = spark.createDataFrame(hub + path + [(20_000, 20_001)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(links, "a", "b").collect()}
    assert found == {**{i: 0 for i in range(4_000)}, **{10_000 + i: 10_000 for i in range(61)}, 20_000: 20_000, 20_001: 20_000}

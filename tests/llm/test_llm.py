"""The training-data operators against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citemill.llm import ann, bpe, chat, fingerprint, jaccard, language_id, packing, quality, queries, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "...", "en", "a", 3), (4, "x" * 50_000, "en", "a", 50_000), (5, "the same", "en", "b", 8), (5, "the same", "en", "b", 8), (None, "no key here", "de", "b", 11)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("keys", F.lit("clash")).withColumn("node", F.lit(1))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def table(small, name):
    return pq.read_table(f"{small}/{name}.parquet").to_pandas()


# -- byte-level BPE --------------------------------------------------------------------
@pytest.mark.parametrize(("chars", "size"), [(17, 7), (5, 3), (40, 20), (512, 512)])
def test_tree_reduction_equals_encoding_at_once(chars, size):
    r = bpe.Ranks(BYTE_BPE, public_tokenizers.PATTERN, chars, size)
    rnd = random.Random(chars)
    alphabet = "ab'sre tl dv m\n\t  é1 23!?#，漢🙂 ſ'\x1c\x85\xa0"
    for k in range(600):
        text = "".join(rnd.choice(alphabet if k % 2 else "abcéthe ingion") for _ in range(rnd.randrange(200)))
        text = text.replace(" ", "") if k % 4 == 0 else text
        ids = r.encode(text)
        assert ids == r.core.encode_ordinary(text)
        assert r.decode(ids, leaf=4) == text.encode()


def test_production_leaves_are_joined():
    r = bpe.Ranks(BYTE_BPE, public_tokenizers.PATTERN)
    rnd, grew = random.Random(8), 0
    for k in range(60):
        words = ["x" * rnd.randrange(1, 900) if k % 6 == 5 else "".join(rnd.choice("etaoiné1漢'-") for _ in range(rnd.randrange(1, 60 if k % 3 else 9))) for _ in range(rnd.randrange(2, 900))]
        text = rnd.choice([" ", "  ", "\n", " \n"] if k % 4 else [" "]).join(words)
        assert r.encode(text) == r.core.encode_ordinary(text)
        assert (r.joins > 0) >= (len(text) > 512)
        grew += r.widened
    assert grew
    for text in ("y" * 50_000, "漢" * 20_000, "\n" * 9_000, "a\n" * 4_000, " " * 5_000 + "b c" + " " * 5_000):
        assert r.encode(text) == r.core.encode_ordinary(text)


def test_bpe_rows(spark, odd, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.bpe_round_trip(odd, BYTE_BPE, public_tokenizers.PATTERN, keep_ids=True).collect()
    assert len(got) == len(ODD)
    texts = sorted(t or "" for _, t, *_ in ODD)
    assert sorted(whole.decode(r.ids) for r in got) == texts
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(r.ids)}I", *r.ids)).hexdigest()
    assert bpe.bpe_round_trip(none, BYTE_BPE, public_tokenizers.PATTERN).count() == 0


# -- packing ----------------------------------------------------------------------------
def test_words_equal_the_tokenizer():
    own, whole = packing.Words(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    whole.encode_special_tokens = True
    assert own.self_encoding()
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aB' éÉ́ \n\t\r\x0b\x1c\xa0İΣß<|endoftext|>'s'RE 12%-漢🙂×÷ÿÀ") for _ in range(rnd.randrange(60))) for _ in range(800)]
    texts += ["".join(rnd.choice("etaoinshrdlü") for _ in range(rnd.randrange(1, 25))) for _ in range(3_000)] + ["", "<|endoftext|> x", "y" * 500]
    assert [np.frombuffer(b, "<u4").tolist() for b in own(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_get_their_ids(spark):
    whole, text = Tokenizer.from_file(WORD_BPE), "a <|endoftext|> b<|startoftext|>É <|EndOfText|> <|endoftext|"
    assert whole.encode("a <|endoftext|> b", add_special_tokens=False).ids == [320, 49407, 321]
    row = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), WORD_BPE).first()
    ids = [*whole.encode(text, add_special_tokens=False).ids, 2]
    assert (row.doc_tokens, row.ids_crc32) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))


def test_plan_holds_every_piece_once():
    rnd = np.random.default_rng(1)
    for size in (1, 8, 64):
        demand = np.concatenate([[0], rnd.integers(0, 40, size)])
        plan = packing.plan(demand, size)
        assert (sum(p * n for p, n in plan) == demand).all() if demand.any() else not plan
        assert all((p * np.arange(size + 1)).sum() <= size for p, _ in plan)
    # no more sequences than the linear program's bound and one a length for rounding
    used, bound = sum(n for _, n in packing.plan(demand * 100, 64)), sum(x for _, x in packing.solve(demand * 100, 64))
    assert max((demand * 100 * np.arange(65)).sum() / 64, (demand * 100)[33:].sum()) <= bound + 1e-6 <= used + 1e-6 and used <= bound + 64
    assert packing.plan(np.zeros(9, dtype=int), 8) == []


def check_packed(rows, docs, capacity, end=2):
    whole = Tokenizer.from_file(WORD_BPE)
    whole.encode_special_tokens = True
    ids = [(k, [*whole.encode(t or "", add_special_tokens=False).ids, end]) for k, t in docs]
    expected = sorted((k is None, k or 0, s, len(c), zlib.crc32(struct.pack(f"<{len(c)}I", *c)), len(x)) for k, x in ids for s in range(0, len(x), capacity) if (c := x[s : s + capacity]))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expected
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, small, odd, none):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack(docs, WORD_BPE).collect()
    d = table(small, "documents")
    n = check_packed(rows, zip(d.doc_id, d.text), 4096)
    assert sum(r.length for r in rows) / (4096 * n) > 0.93
    check_packed(packing.pack(odd, WORD_BPE, capacity=64, unit=4).collect(), [(k, t) for k, t, *_ in ODD], 64)
    assert packing.pack(none, WORD_BPE).count() == 0


# -- fingerprints --------------------------------------------------------------------------
def test_fingerprints(spark, small, odd, none):
    def brute(rows):
        out = []
        for (k, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
            half = len(t) // 2
            e = t[: len(t) - half] + u[:half]
            d = [fingerprint.digest(x.encode()) for x in (t, e, u)]
            out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.encode(d[0]), fingerprint.encode(d[1]), fingerprint.likeness(d[0], d[1]), fingerprint.likeness(d[0], d[2])))
        return sorted(out, key=str)

    d = table(small, "documents")
    rows = sorted(zip(d.doc_id, d.text), reverse=True)
    for block in (7, 50, 4_000):
        got = fingerprint.fingerprints(spark.read.parquet(f"{small}/documents.parquet"), rows_per_block=block).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.fingerprint, r.fingerprint) == r.fingerprint and 0 <= r.near_next <= 1
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.95
    least = -(2**63)
    odd_rows = sorted([(k, t or "") for k, t, *_ in ODD], key=lambda r: (-(r[0] if r[0] is not None else least), r[1]))
    assert sorted(map(tuple, fingerprint.fingerprints(odd, rows_per_block=2).collect()), key=str) == brute(odd_rows)
    assert fingerprint.fingerprints(none).count() == 0
    alone = fingerprint.fingerprints(odd.where("doc_id = 4")).first()
    assert alone.near_next == 1.0
    assert (fingerprint.decode(alone.fingerprint) == fingerprint.digest(b"x" * 50_000)).all()


def digest_by_counting(data):
    """Triplets counted one by one; the digest's header and a quartile for each bucket."""
    from math import log2

    word, counts = 2**32, [0] * 256
    for i in range(len(data) - 3):
        w, *rest = data[i : i + 4]
        for row, (p, q) in zip(fingerprint._MIX.tolist(), ((0, 1), (0, 2), (1, 2))):
            h = ((w + 1) * row[0] ^ (rest[p] + 1) * row[1]) % word * 0x2C1B3C6D % word
            h = ((h ^ (rest[q] + 1) * row[2]) % word) * 0x297A2D39 % word
            counts[h >> 24] += 1
    q1, q2, q3 = (sorted(counts)[k * 64 - 1] for k in (1, 2, 3))
    return [min(255, round(8 * log2(1 + len(data)))), 15 * q1 // q3 if q3 else 0, 15 * q2 // q3 if q3 else 0, *((c > q1) + (c > q2) + (c > q3) for c in counts)]


def test_digests_against_counting():
    rnd = random.Random(12)
    texts = [bytes(rnd.choices(range(256), k=n)) for n in (4, 5, 40, 700, 3_000)] + [b"x" * 500, ("é漢 tide " * 60).encode()]
    digests = [fingerprint.digest(t) for t in texts]
    assert [d.tolist() for d in digests] == [digest_by_counting(t) for t in texts]
    steps = {frozenset((0, 3)): 6, frozenset((0, 2)): 2, frozenset((1, 3)): 2}
    for a in digests:
        for b in digests:
            want = sum(abs(int(x) - int(y)) for x, y in zip(a[:3], b[:3])) + sum(steps.get(frozenset((int(x), int(y))), abs(int(x) - int(y))) for x, y in zip(a[3:], b[3:]))
            assert fingerprint.difference(a, b) == min(fingerprint.BOUND, want) and 0 <= fingerprint.likeness(a, b) <= 1
    assert fingerprint.digest(b"abc").tolist() != fingerprint.digest(b"abd").tolist()


# -- language -----------------------------------------------------------------------------
def test_language(spark, small, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[5].lang_pred in ("en", "de")
    assert language_id.identify(none).count() == 0
    same = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit(None))
    assert sorted(language_id.identify(same).collect()) == sorted(language_id.identify(docs).collect())


def languages_by_counting(train, texts, floor=2.0):
    """Word-first backoff, entry by entry: train (text, lang) -> for each text (lang, score)."""
    from collections import Counter
    from math import exp, log

    langs = sorted({g for _, g in train}, key=lambda g: (-sum(h == g for _, h in train), g))
    words, grams = {g: Counter() for g in langs}, [{g: Counter() for g in langs} for _ in range(5)]
    for t, g in train:
        words[g].update(language_id.WORD.findall(t.lower()))
    for g in langs:
        for w, c in words[g].items():
            for n in range(1, 5):
                for k in range(len(w) + 2 - n + 1):
                    grams[n][g][f"<{w}>"[k : k + n]] += c

    def scores(by, entry):
        if not any(entry in by[g] for g in langs):
            return None
        totals = [max(1, sum(by[g].values())) for g in langs]
        return [log(by[g][entry] / n) if by[g][entry] else -log(max(totals)) - floor for g, n in zip(langs, totals)]

    def word_scores(w):
        if (own := scores(words, w)) is not None:
            return own
        for n in (4, 3, 2, 1) if any(map(str.isalpha, w)) else ():
            known = [x for k in range(len(w) + 2 - n + 1) if (x := scores(grams[n], f"<{w}>"[k : k + n])) is not None]
            if known:
                return [sum(col) / len(known) for col in zip(*known)]
        return None

    out = []
    for t in texts:
        ws = language_id.WORD.findall((t or "").lower())
        known = [x for w in ws if (x := word_scores(w)) is not None]
        if not any(c.isalpha() for w in ws for c in w):
            out.append(("und", 0.0))
        elif not known:
            out.append((langs[0], 1 / len(langs)))
        else:
            total = [sum(col) * min(1, 50 / len(known)) for col in zip(*known)]
            p = [exp(x - max(total)) for x in total]
            out.append((langs[p.index(max(p))], max(p) / sum(p)))
    return out


def invented(rnd, seeds, n):
    """Texts of made-up words, each language of its own syllables."""
    return [(" ".join("".join(rnd.choices(seeds[g], k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(1, 25))), g) for _ in range(n) for g in [rnd.choice(list(seeds))]]


def test_language_against_counting(spark):
    rnd = random.Random(9)
    rows = invented(rnd, {"aa": ["ba", "lo", "mi", "tu"], "bb": ["ba", "kro", "mi", "zz"], "cc": ["ey", "lo", "ñu"]}, 120)
    rows += [(None, "aa"), ("", "bb"), ("12 --", "cc"), ("qqq xxx", None), ("ba ba", "aa"), ("ba ba", "bb"), ("lo " * 5_000, "cc")]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string").withColumn("__p", F.lit("clash"))
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(len(rows))]
    want = languages_by_counting([(t, g) for (t, g), h in zip(rows, held) if not h and t is not None and g is not None], [t for t, _ in rows])
    got = sorted(language_id.identify(df).collect())
    assert [r.lang_pred for r in got] == [g for g, _ in want] and [r.score for r in got] == pytest.approx([p for _, p in want], abs=1e-4)
    kept = language_id.reject_unidentified(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, (g, p) in enumerate(want) if g != "und" and p >= 0.5]


def test_backoff_takes_the_longest_known_grams():
    words, grams = language_id.Table(["the"], np.array([[0, -9]])), [language_id.Table(["<d"], np.array([[-9, 0]])), language_id.Table(["e"], np.array([[-1, -2]]))]
    m = language_id.Backoff(["a", "b"], words, language_id.joined(grams), 4)
    rows, known = m.rows(["the", "den", "ze", "zz", "²", "eed"])
    assert rows.tolist() == [[0, -9], [-9, 0], [-1, -2], [0, 0], [0, 0], [-1, -2]] and known.tolist() == [True, True, True, False, False, True]
    assert language_id.Scorer(m)("the den")[0] in "ab"


# -- Jaccard join ------------------------------------------------------------------------
def linked_components(docs, width, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])

    sets, up = {k: shingles(t) for k, t in docs}, {k: k for k, _ in docs}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_components_never_stop_short(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    assert {r.root for r in jaccard.components(links).collect()} == {0}
    with pytest.raises(RuntimeError):
        jaccard.components(links, rounds=2)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_against_all_pairs(spark, width, percent):
    rnd = random.Random(width)
    words = [f"w{i}" for i in range(3_000)]
    passage = rnd.choices(words, k=60)
    docs = []
    for family in range(14):
        base = rnd.choices(words, k=rnd.choice((3, 9, 14, 40, 120, 500)))
        for copy in range(40 if family == 3 else 6):
            text = list(base)
            for _ in range(rnd.choice((0, 0, 1, 1, 2, 3))):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            if copy % 5 == 4:
                text += passage
            docs.append((len(docs), " ".join(text)))
    docs += [(len(docs), "A b C d"), (len(docs) + 1, "a B c D"), (len(docs) + 2, ""), (len(docs) + 3, None), (len(docs) + 4, "\u00a0")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_classes(df, width=width, percent=percent, most_rows=7).collect()}
    assert got == linked_components(docs, width, percent)
    kept = {r.doc_id for r in jaccard.keep_representatives(df, width=width, percent=percent).collect()}
    assert kept == {c for _, c in got.values()}


def test_repeated_keys_keep_one_row_a_text(spark):
    a, b, c, d = ("{0}1 {0}2 {0}3 {0}4 {0}5 {0}6".format(x) for x in "abcd")
    docs = [(1, a), (1, a), (5, a), (5, b), (6, b), (7, c), (7, c.upper()), (8, d), (8, d), (8, ""), (8, ""), (9, None), (None, d), (None, d)]
    kept = [tuple(r) for r in jaccard.keep_representatives(spark.createDataFrame(docs, "doc_id long, text string"), width=4, percent=80).collect()]
    # one of 7's two spellings stands for both; rows without a key stay
    assert sorted(((k, t.lower() if k == 7 else t) for k, t in kept), key=str) == sorted([(1, a), (5, b), (7, c), (8, d), (8, ""), (9, None), (None, d), (None, d)], key=str)


def test_jaccard_odd_rows(odd, none):
    got = jaccard.join_classes(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id == 5} == {5}
    assert jaccard.join_classes(none).count() == 0


def test_bounds_are_bounds():
    rnd = random.Random(5)
    sets = []
    for k in range(80):
        h = np.unique(np.array([rnd.getrandbits(64) % 5_000 * 0x9E3779B97F4A7C15 % 2**64 for _ in range(rnd.randrange(30, 400))], dtype=np.uint64))
        # copies that differ in about a tenth, some of them more often than their neighbours in size
        sets.append(h if k % 3 else np.unique(np.concatenate([sets[k - 1][len(h) // 9 :], h[: len(h) // 9]])) if k else h)
    sets.sort(key=len)
    sizes, points, cells = np.array([len(h) for h in sets]), np.array([np.bincount((h & np.uint64(31)).astype(int), minlength=32) for h in sets]), [jaccard.cells_of(h) for h in sets]
    rank = np.bincount(jaccard.bucket_of(np.concatenate(sets)), minlength=jaccard.BUCKETS)
    tree, linked = jaccard.RTree(points, sizes), 0
    for i in range(80):
        near = set(tree.near(points[i], int(sizes[i]), 85).tolist())
        bounds = jaccard.cells_bound(int(sizes[i]), cells[i], sizes, cells)
        for j in range(80):
            common = len(np.intersect1d(sets[i], sets[j]))
            assert common <= np.minimum(points[i], points[j]).sum() and common <= bounds[j]
            if 100 * common >= 85 * (sizes[i] + sizes[j] - common):
                linked += i < j
                assert j in near and set(jaccard.leading(sets[i], 85, rank)) & set(jaccard.leading(sets[j], 85, rank))
    assert linked


def test_common_shingles_come_last():
    h = np.sort(np.random.default_rng(1).integers(0, 2**64, 100, dtype=np.uint64))
    rank = np.full(jaccard.BUCKETS, 500, dtype=np.uint32)
    rank[jaccard.bucket_of(h[:50])] = 600
    assert len(jaccard.leading(h, 85, rank)) == 18 and set(jaccard.leading(h, 85, rank).view(np.uint64)) <= set(h[50:])


# -- nearest neighbours -------------------------------------------------------------------
def recall_of(rows, x, ids):
    got = defaultdict(list)
    for r in rows:
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = (x * x[ids == q][0]).sum(axis=1)
        s[ids == q] = -np.inf
        top = ids[np.lexsort((ids, -s))][:20]
        found = sorted(got[q])
        hits, total = hits + len(set(top) & {v for _, v, _ in found}), total + 20
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-p, v) for _, v, p in found] == sorted((-p, v) for _, v, p in found)
        assert all(p == s[ids == v][0] for _, v, p in found)
    return hits / total


@pytest.mark.parametrize(("folder", "how"), [("/root/testdata/sf0.001", {"rows_per_part": 100, "block_rows": 40, "block_queries": 7}), ("/root/testdata/sf0.1", {})])
def test_nearest(spark, folder, how):
    e = table(folder, "embeddings")
    found = ann.search(spark.read.parquet(f"{folder}/embeddings.parquet"), **how).collect()
    assert recall_of(found, np.stack(e.embedding.values).astype(np.float64), e.vec_id.values) >= 0.9


def test_nearest_in_a_large_block(spark):
    """Production parameters, and several centres, where a scan cuts hard: 12,000 vectors in clusters of unlike lengths."""
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(40, 32))
    x = (centres[rnd.integers(0, 40, 12_000)] + rnd.normal(size=(12_000, 32)) * 0.7) * rnd.uniform(0.5, 2, (12_000, 1))
    x, ids = x.astype(np.float32).astype(np.float64), np.arange(12_000) * 2
    df = spark.createDataFrame(zip(ids.tolist(), x.tolist()), "vec_id long, embedding array<float>")
    assert recall_of(ann.search(df).collect(), x, ids) >= 0.9
    assert recall_of(ann.search(df, rows_per_part=2_000).collect(), x, ids) >= 0.9


def test_nearest_odd_vectors(spark):
    v = [(20, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [1.0, 0.0, 2.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, [1.0]), (40, [2.0]), (9, [-1.0, 0.0, 1.0]), (1, [1.0, 0.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    assert [tuple(r) for r in ann.search(df).orderBy("query_id", "rank").collect()] == [(20, 1, 1, 5.0), (20, 2, 2, 5.0), (20, 3, 9, 1.0), (40, 1, 8, 2.0)]
    assert ann.search(df.where("vec_id < 0")).count() == 0


# -- URL filter ------------------------------------------------------------------------------
def split_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def fixed_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark, small):
    urls = [None, "", "nothing", "http://A.EXAMPLE.org/es/1?x#y", "http://example.org/en/12", "http://org", "http://notexample.org/es/", "ftp://x.com/fr/a://b.org/", "http://b.com/de/x", "//x.org/", "http://com/fr/", "http://é.COM/fr/ü", "http://a.com?u=http://b.org/es/x", "http://example.org#://y/en/1", "http://com?://z/de/", "://org", "a\nb://EXAMPLE.org\n/es/", "http://x.com/de/" + "y" * 50_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    for r in url_filter.judge(df).collect():
        host, path = split_url(urls[r.page_id])
        rule, verdict = fixed_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = url_filter.judge(pages).join(pages.select("page_id", "url"), "page_id").collect()
    for r in got:
        host, path = split_url(r.url)
        assert (r.host, r.path, r.rule) == (host, path, fixed_rule(host, path)[0])
    assert any(r.mined and r.verdict == "block" for r in got)
    assert url_filter.judge(df.where("page_id < 0")).count() == 0
    assert not any(s in url_filter.judge(pages)._jdf.queryExecution().toString() for s in ("Python", "Arrow", "Exchange"))


def mined_by_counting(rows, min_support, min_confidence):
    """All combinations of tokens, counted one by one, without those that a part betters or equals."""
    from itertools import combinations

    n, counts = len(rows), defaultdict(lambda: defaultdict(int))
    for tokens, label in rows:
        for size in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), size):
                counts[c][label] += 1
    good = {(frozenset(c), v): k / sum(by.values()) for c, by in counts.items() for v, k in by.items() if k >= min_support * n and k / sum(by.values()) >= min_confidence}
    return {(c, v): (conf, counts[tuple(sorted(c))][v] / n) for (c, v), conf in good.items() if not any(d < c and w == v and other >= conf for (d, w), other in good.items())}


def best_by_counting(tokens, rules):
    """Verdicts of the rules that fit best; several where they are alike in confidence and support."""
    fits = [(conf, sup, v) for (c, v), (conf, sup) in rules.items() if c <= set(tokens)]
    return {v for *score, v in fits if score == list(max(fits)[:2])}


@pytest.mark.parametrize("seed", range(4))
def test_mining_against_counting(spark, seed):
    from itertools import product

    rnd = random.Random(seed)
    rows = []
    for i in range(300):
        tokens = {f"t{rnd.randrange(6)}" for _ in range(4)} | {"all"}
        tokens |= {"t0 too", "t0 as well"} if "t0" in tokens else set()
        label = "block" if ("t1" in tokens) == ("t2" in tokens) or not rnd.randrange(8) else "allow"
        rows.append((sorted(tokens | ({"only"} if label == "block" and i % 9 == 0 else set())), label))
    mined = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), min_support=0.03, min_confidence=0.7)
    want = mined_by_counting(rows, 0.03, 0.7)
    # a rule on classes stands for one rule for each choice of a token of each
    got = {(frozenset(c), v): (conf, sup) for classes, v, conf, sup in mined for c in product(*classes)}
    assert got.keys() == want.keys() and any(len(c) > 1 for c, _ in got) and any(len(k) > 1 for r in mined for k in r[0])
    assert all(got[r] == pytest.approx(want[r]) for r in got)


def test_verdicts_against_counting(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    url = F.col("url")
    tokens = {r.page_id: list(r.t) for r in pages.select("page_id", url_filter.tokens_of(url, url_filter.host_of(url), url_filter.path_of(url)).alias("t")).collect()}
    got = {r.page_id: r for r in url_filter.judge(pages, min_support=0.04).collect()}
    fixed = {i: fixed_rule(r.host, r.path) for i, r in got.items()}
    rules = mined_by_counting([(tokens[i], v) for i, (name, v) in fixed.items() if name], 0.04, 0.8)
    best = {i: {v} if v else best_by_counting(tokens[i], rules) or {"allow"} for i, (_, v) in fixed.items()}
    assert all(r.verdict in best[i] for i, r in got.items())
    mined = [i for i, (name, _) in fixed.items() if not name]
    assert {v for i in mined for v in best[i]} == {"allow", "block"} and sum(len(best[i]) == 1 for i in mined) > 30


def test_every_mined_rule_is_kept(spark):
    rules = [("block", "a.org", "/"), ("allow", "b.org", "/")]
    word = lambda i: "w" + chr(97 + i // 26) + chr(97 + i % 26)
    urls = [f"http://{'ab'[i % 2]}.org/{word(i)}" for i in range(160) for _ in range(2)] + [f"http://c.net/{word(i)}" for i in range(160)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules, min_support=0.005)
    assert {r.page_id - 320: (r.verdict, r.mined) for r in got.where("page_id >= 320").collect()} == {i: (("block", "allow")[i % 2], f"p0:{word(i)}") for i in range(160)}


def test_rules_of_any_length(spark):
    rules, names = [("block", "a.org", "/"), ("allow", "b.org", "/")], "abcde"
    urls = ["http://a.org/?" + "&".join(names)] * 10 + ["http://b.org/?" + "&".join(names.replace(x, "")) for x in names for _ in range(10)] + ["ftp://c.net/?" + "&".join(names)]
    last = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).where("page_id = 60").first()
    assert (last.verdict, last.mined) == ("block", "q:a q:b q:c q:d q:e")


# -- chat --------------------------------------------------------------------------------------
TRICKY = ["\\### Assistant: </turn> ok", "", "\\", "\\\\### x: y </turn>\n", "a: b", " </turn>\n### user: z", "### ", "line\nline", "🙂" * 3]


def test_turns_read_back():
    rnd = random.Random(4)
    for _ in range(300):
        turns = [(rnd.choice(["user", "assistant", "a: b", "", "### x"]), "".join(rnd.choices(TRICKY, k=rnd.randrange(4)))) for _ in range(rnd.randrange(6))]
        assert chat.parse("".join(chat.format_turn(*t)[0] for t in turns)) == turns


def test_trees(spark):
    rnd = random.Random(6)
    rows, order = [], 0
    for c in range(60):
        for i in range(rnd.randrange(1, 6)):
            rows.append((c, i, rnd.choice(["system", "user"]) if i % 2 == 0 else "assistant", "shared first turn" if i == 0 and c % 3 else rnd.choice(TRICKY) + rnd.choice(["", "x"])))
    rows += [(70, None, None, None), (70, 0, "user", "q"), (70, 0, "assistant", "a"), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    packs = chat.trees(df, most_conversations=9)
    got = {r.conv_id: r for r in chat.read_back(packs).collect()}
    want = defaultdict(list)
    for c, i, r, t in sorted(rows, key=lambda x: (str(x[0]), -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        want[c].append((r or "", t or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        said, learnt = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        formatted = "".join(chat.format_turn(*t)[0] for t in turns)
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(formatted))
    for p in packs.collect():  # a node's position is its path's length
        for n in p.nodes:
            assert n.position == sum(a.stop - a.start for a in [*p.context[: n.outside], *n.attends])
    # each shared turn is written once in all packs
    prefixes = {tuple(turns[:k]) for turns in want.values() for k in range(1, len(turns) + 1)}
    assert sum(len(p.text) for p in packs.collect()) == sum(len(chat.format_turn(*x[-1])[0]) for x in prefixes)
    assert chat.read_back(chat.trees(df.where("conv_id < 0"))).count() == 0


@pytest.mark.parametrize(("ranges", "most"), [(1, 512), (4, 512), (211, 512), (4, 1)])
def test_shared_turns_are_written_once(spark, ranges, most):
    # six conversations share nine turns, four of them ten; two more are the nine alone, one is another's start
    rows = [(c, i, "user" if i % 2 else "assistant", f"turn {i}" + f" of {c}" * (i > 9 or i == 9 and c > 3)) for c in range(6) for i in range(9 + c % 3 + 1)]
    rows += [(c, i, "user" if i % 2 else "assistant", f"turn {i}") for c, k in ((10, 9), (11, 9), (12, 4)) for i in range(k)] + [(13, 0, "user", "y" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packs = chat.trees(df, ranges=ranges, most_conversations=most, most_chars=100_000)
    by = defaultdict(list)
    for c, _, r, t in rows:
        by[c].append((r, t))
    prefixes = {tuple(turns[:k]) for turns in by.values() for k in range(1, len(turns) + 1)}
    written = [(n.node, p.text[n.start : n.stop]) for p in packs.collect() for n in p.nodes if n.node is not None]
    assert len(written) == len(set(written)) == len(prefixes)
    assert sorted(t for _, t in written) == sorted(chat.format_turn(*x[-1])[0] for x in prefixes)
    got = {r.conv_id: r for r in chat.read_back(packs).collect()}
    for c, turns in by.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), hashlib.sha256(learnt.encode()).hexdigest())
    assert len(got) == len(by)


# -- quality ---------------------------------------------------------------------------------
def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("pmod(xxhash64(doc_id, 3), 2) = 0")
    got = quality.score(docs, half).join(labels.subtract(half).select("doc_id", "quality"), "doc_id").select("quality", "quality_score").toPandas()
    assert (got.quality_score >= 0.5)[got.quality == 1].mean() > 0.99 and (got.quality_score < 0.5)[got.quality == 0].mean() > 0.9


def test_posteriors_shrink(spark):
    rows = [("big", "p", 1)] * 80 + [("big", "p", 0)] * 20 + [("bad", "p", 0)] * 50 + [("one", "q", 0)]
    m, post = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, good int"))
    by = {r.host: r for r in post.collect()}
    assert m == pytest.approx(80 / 151)
    assert by["bad"].host_posterior < by["one"].host_posterior < m < by["big"].host_posterior < 0.8


def quality_by_counting(docs, labels):
    """Evidence and posteriors by loops over documents (id, text, host, path) and labels (id, 0 or 1) -> scores."""
    from math import exp, log

    marks = defaultdict(list)
    for i, y in labels:
        marks[i].append(y)
    good = {i: int(np.mean(y) >= 0.5) for i, y in marks.items()}
    seen = [(d, good[d[0]]) for d in docs if d[0] in good]
    model = quality.fit(np.stack([quality.features(d[1] or "") for d, _ in seen]).astype(np.float64), np.array([y for _, y in seen], dtype=np.float64))

    def counted(of):
        by = defaultdict(lambda: [0, 0])
        for d, y in seen:
            by[of(d)][0] += 1
            by[of(d)][1] += y
        return by

    def weight(groups, centre):
        n, g, k = sum(x[0] for x in groups.values()), sum(x[1] for x in groups.values()), len(groups)
        m = min(max(g / n, 1e-3), 1 - 1e-3)
        spread = sum(a * (b / a - centre(site)) ** 2 for site, (a, b) in groups.items())
        room = n - sum(a * a for a, _ in groups.values()) / n
        between = max(0.0, (spread - (k - 1) * m * (1 - m)) / room) if room > 0 else 0.0
        return m, min(10_000.0, max(1.0, m * (1 - m) / between - 1)) if between > 0 else 10_000.0

    hosts, paths = counted(lambda d: d[2]), counted(lambda d: (d[2], d[3]))
    share = sum(y for _, y in seen) / len(seen)
    m, w = weight(hosts, lambda _: share)
    host = {h: (b + m * w) / (a + w) for h, (a, b) in hosts.items()}
    _, v = weight(paths, lambda s: host[s[0]])
    path = {s: (b + host[s[0]] * v) / (a + v) for s, (a, b) in paths.items()}
    out = []
    for i, t, h, p in docs:
        site = path.get((h, p), host.get(h, m))
        odds = float(model.log_odds(quality.features(t or "").astype(np.float64)[None, :])[0]) + log(site / (1 - site))
        out.append(0.0 if not (t or "").strip() else 1 / (1 + exp(-odds)))
    return out


def test_quality_against_counting(spark):
    rnd = random.Random(11)
    docs, labels = [], []
    for i in range(240):
        bad = rnd.random() < (0.7 if i % 5 == 0 else 0.2)
        text = "".join(rnd.choice("xq!$#7 |") for _ in range(80)) if bad else " ".join(rnd.choice(["the", "tide", "rose", "slowly", "and", "fell."]) for _ in range(30))
        docs.append((i, text, f"host{i % 5}" if i % 7 else None, f"p{i % 3}"))
        if i % 2:
            labels += [(i, int(not bad))] * (1 + i % 3)
    docs += [(500, None, "host1", "p1"), (501, " \n", "host1", None), (502, "the tide rose", "elsewhere", "p1"), (1, docs[1][1], "host1", "p1"), (None, "the tide fell.", "host2", "p2")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").withColumn("quality_score", F.lit("clash")).withColumn("__k", F.lit(1)).withColumn("__h", F.lit(2))
    marks = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, quality int")
    want = quality_by_counting(docs, labels)
    scored = quality.score(df.drop("quality_score"), marks)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = sorted([(r.doc_id, r.text, r.quality_score) for r in scored.collect()], key=key)
    assert [r[2] for r in got] == pytest.approx([w for _, w in sorted(zip(docs, want), key=lambda x: key(x[0]))], abs=1e-6)
    kept = quality.reject_poor(df, marks)
    assert kept.columns == df.columns and {r.quality_score for r in kept.collect()} == {"clash"}
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=key) == sorted([d[:2] for d, w in zip(docs, want) if w >= 0.5], key=key)
    assert quality.reject_poor(df, marks.where("doc_id < 0")).count() == len(docs) - 2 and quality.reject_poor(df.where("doc_id < 0"), marks).count() == 0


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 1), (5, 1), (5, None), (None, 1), (99, 0)], "doc_id long, quality int")
    got = quality.score(odd, labels)
    assert got.columns[: len(odd.columns)] == odd.columns and got.count() == len(ODD)
    assert all(0 <= r.quality_score <= 1 and (r.quality_score == 0) == (not (r.text or "").strip()) for r in got.collect())
    assert quality.score(odd, labels.where("doc_id < 0")).where("text = 'the same'").first().quality_score == 0.5
    assert quality.score(none, labels).count() == 0


# -- WARC --------------------------------------------------------------------------------------
PAGES = [(3, "http://a/", "same"), (1, "http://b/ x\r\ny", "same"), (2, None, None), (5, "u", ""), (7, "u", "é" * 50), (None, "u", "same"), (9, "u", "z"), (9, "u", "z")] + [(100 + i, f"http://c/{i}", f"<p>page {i % 40} of many pages</p>" * 30) for i in range(200)]


def test_warc(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha", F.lit("clash")).repartition(3)
    manifest = warc.write_archives(df, f"file://{tmp_path}/w", records_per_file=50)
    assert sum(r.records for r in manifest.collect()) == len(PAGES) and manifest.count() >= 4
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = sorted(((i is None, i or 0), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i == first[h or ""] else "revisit", None if i == first[h or ""] else first[h or ""]) for i, _, h in PAGES)
    got = sorted(((r.page_id is None, r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(manifest).collect())
    assert [str(x) for x in got] == [str(x) for x in want]
    path = manifest.first().path.removeprefix("file://")
    with open(path, "rb") as f:
        magic, size = struct.unpack("<II", f.read(8))
        dictionary = f.read(size)
    assert magic == warc.DICT_MAGIC and dictionary[:4] == b"\x37\xa4\x30\xec"
    empty = warc.write_archives(df.where("page_id < 0"), f"file://{tmp_path}/e")
    assert warc.read_archives(empty).count() == 0


# -- pipeline ---------------------------------------------------------------------------------
def test_pipeline_against_its_stages(spark, small):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "n-gram Jaccard join", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, stage(spark, kept, small)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert 0 < kept.count() <= before.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert not any(labels.get(i) == 0 for i in ids)
    comps = linked_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert ids == {c for _, c in comps.values()}
    rows = corpus_pipeline.run(spark, small).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in kept.collect()], 4096)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, an empty table, columns of any name."""
    import corpus_pipeline

    labels = [(1, 1, 0), (2, 0, 0), (3, 1, 0), (None, None, None), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    good = "the tide rose slowly and the boats turned on their ropes before evening came to the harbour"
    docs = [(1, good, "en", "a", 1), (1, good, "en", "a", 1), (2, "$$ ## !!", "en", "a", 2), (3, good + " again", "en", None, None), (4, None, None, None, None), (5, "", "en", "a", 0), (None, good, "en", "a", 3), (6, "tide " * 30_000, "en", "b", 4), (7, "…", None, None, 5)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' AS __p", "'x' AS __k", "'x' AS __digest", "'x' AS __score", "1 AS component_id", "'x' AS `a.b`")
    for table_ in (df, df.where("doc_id < 0")):
        kept = table_
        for name, stage in corpus_pipeline.STAGES[:3]:
            before, kept = kept, stage(spark, kept, f"file://{tmp_path}")
            assert kept.columns == df.columns, name
            kept = spark.createDataFrame(kept.collect(), df.schema)
            assert kept.count() <= before.count()
        rows = corpus_pipeline.STAGES[-1][1](spark, kept, f"file://{tmp_path}").collect()
        check_packed(rows, [(r.doc_id, r.text) for r in kept.collect()], 4096)
    assert {r.doc_id for r in rows} == set()


def test_every_operator_has_a_query():
    assert [sum(name.startswith(f"op{n}_") for name in queries.queries()) for n in range(1, 11)] == [1] * 10

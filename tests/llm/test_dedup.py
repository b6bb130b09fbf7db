"""Near-duplicates, repeated passages and nearest neighbours against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandlake.llm import ann, neardup, substrings
from strandlake.llm.common import Roller, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b])):
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    part[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def check_dedup(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.deduplicate(docs).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_of_documents(spark, sf_dir):
    check_dedup(spark, table(spark, sf_dir, "documents"))


def test_families_chains_and_short_texts(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(60):  # copies near the base, not all near each other
        w = list(base)
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    chain = [word() for _ in range(100)]
    for k in range(0, 60, 4):  # each near the next, the ends far apart
        texts.append(" ".join([*chain[k:], *(word() for _ in range(k))]) if k else " ".join(chain))
        chain = texts[-1].split()
    texts += ["a b c", "A B C", "a b c d", "x", None, "", "  ", "a b c d e"] + ["q w e r t y"] * 5
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("clash"))
    check_dedup(spark, docs)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == {i for i, (_, c) in brute_components(dict(enumerate(texts))).items() if i == c}


def test_repeated_rows_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None), (7, "A b c d e")], "doc_id long, text string")
    got = sorted((x["doc_id"] or 0, x["component_id"] or 0, x["kept"]) for x in neardup.deduplicate(docs).collect())
    assert got == [(0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (7, 1, False)]
    assert sorted(x["doc_id"] or 0 for x in neardup.keep_one(docs).collect()) == [0, 0, 1]
    assert neardup.deduplicate(docs.limit(0)).count() == 0


def test_signatures_fill_empty_bins():
    of, hashes = neardup.shingle_sets([b"a b c d", b"", " ".join(map(str, range(600))).encode()])
    sig = neardup.signatures(of, hashes, 3)
    assert len(set(sig[0].tolist())) == 1 and not sig[1].any() and (sig[2] > 0).all()
    agree = []
    for seed in range(30):
        r = random.Random(seed)
        a = [str(r.random()) for _ in range(303)]
        b = list(a)
        b[100:117] = [str(r.random()) for _ in range(17)]  # 20 of 300 shingles differ: Jaccard 0.875
        s = neardup.signatures(*neardup.shingle_sets([" ".join(a).encode(), " ".join(b).encode()]), 2)
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - 280 / 320) < 0.02


def test_likely_pairs_of_a_bucket_with_several_components(spark):
    """What a star leaves out: two members unlike the centre, alike to each other."""
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 65536, (40, neardup.BINS)).astype("<u2")
    sig[21:30] = sig[20]
    members = spark.createDataFrame([(5, i, 0 if i < 20 else i) for i in range(40)], "key long, id long, component long")
    sigs = spark.createDataFrame([(i, 100, sig[i].tobytes()) for i in range(40)], "id long, n long, sig binary")
    got = {(x["a"], x["b"]) for x in neardup._likely_pairs(members, sigs, 100).collect()}
    assert got == {(a, b) for a in range(20, 30) for b in range(a + 1, 30)}
    few = {(x["a"], x["b"]) for x in neardup._likely_pairs(members, sigs, 2).collect()}
    assert few <= got and {x for p in few for x in p} == set(range(20, 30))


@pytest.mark.parametrize("common, only", [(4, (1, 0)), (8, (1, 1)), (12, (3, 0)), (16, (2, 2)), (32, (8, 0)), (51, (6, 6)), (52, (13, 0)), (96, (12, 12))])
def test_no_pair_at_the_threshold_is_lost(common, only):
    """20,000 pairs of 4 of 5 shared shingles and larger ones: all share a bucket and pass the signature test."""
    rng, m, x, y = np.random.default_rng(common), 20_000, *only
    h = rng.integers(0, 2**64, (m, common + x + y), np.uint64, endpoint=False)
    first, second = np.sort(h[:, : common + x], axis=1), np.sort(np.concatenate([h[:, :common], h[:, common + x :]], axis=1), axis=1)
    same = neardup.signatures(np.repeat(np.arange(m), common + x), first.ravel(), m) == neardup.signatures(np.repeat(np.arange(m), common + y), second.ravel(), m)
    assert neardup.agreeing(same.sum(1), np.full(m, common + x), np.full(m, common + y)).all()
    assert same.reshape(m, neardup.BANDS, neardup.ROWS).all(2).any(1).all()


def test_families_of_several_components(spark, monkeypatch):
    """Families in many small blocks, with links that only the second comparison finds, equal brute force."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    r = random.Random(9)
    texts = {}
    for family in range(3):
        base = [f"f{family}w{k}" for k in range(60)]
        for copy in range(25):
            words = list(base)
            at = r.randrange(50)
            words[at : at + r.choice([1, 2, 9])] = [f"x{r.random()}"]
            texts[family * 100 + copy] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    families = spark.createDataFrame([(i, i // 100 * 100, 60) for i in texts], "id long, family long, n long")
    parts = {x["node"]: x["component"] for x in neardup.link_families(docs, families).collect()}
    expected = {i: c for i, (_, c) in brute_components(texts).items()}
    assert {i: parts.get(i, i) for i in texts} == expected and len(set(expected.values())) > 3


def test_hashes_do_not_depend_on_place_or_blocks():
    roll = Roller(2)
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 100, 5 * Roller.STEP, np.uint8, endpoint=True)
    part = raw[:1000]
    raw[3 * Roller.STEP - 500 : 3 * Roller.STEP + 500] = part
    starts = np.array([0, 3 * Roller.STEP - 500, 3 * Roller.STEP - 499])
    ends = np.array([1000, 3 * Roller.STEP + 500, 3 * Roller.STEP + 501])
    a, b, c = roll.words(raw, starts, ends)
    assert a == b != c and a == roll.words(part, np.array([0]), np.array([1000]))[0]
    values = rng.integers(0, 2**64, 3 * Roller.STEP, np.uint64, endpoint=False)
    values[-10:] = values[:10]
    x, y = roll.spans(values, np.array([0, len(values) - 10]), np.array([10, len(values)]))
    assert x == y


@pytest.mark.parametrize("two_sides", [False, True])
def test_links_of_a_block(two_sides):
    r = random.Random(6)
    base = r.sample(range(10**6), 60)
    sets = [np.array(sorted({*r.sample(base, 60 - r.randrange(0, 9)), *r.sample(range(10**7), r.randrange(0, 5))}), np.uint64) for _ in range(40)]
    side = np.array([k % 2 if two_sides else 0 for k in range(40)])
    part = list(range(40))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(40):
        for b in range(a):
            common = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            if (not two_sides or side[a] != side[b]) and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                part[y] = x
    assert dict(neardup._links_within(sets, side, 80)) == {k: find(k) for k in range(40) if find(k) != k}


def test_large_families_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    test_families_chains_and_short_texts(spark)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)]
    part = {}

    def find(x):
        part.setdefault(x, x)
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        part[y] = x
    got = {x["node"]: x["component"] for x in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(part) if find(i) != i}


# --- repeated passages


def brute_repeats(texts, width=50):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def check_repeats(docs, width=50, **options):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(docs, width, **options).collect()}
    assert got == brute_repeats(texts, width)


@pytest.mark.parametrize("most_bits", [1 << 30, 1 << 9])
def test_repeated_passages_of_documents(spark, sf_dir, most_bits):
    """Also with a sketch far too small: it lets through more, and the result is the same."""
    check_repeats(table(spark, sf_dir, "documents"), most_bits=most_bits)


def test_passages_within_and_across_texts(spark):
    r = random.Random(4)
    text = lambda n: [r.choice("abcdefghijklmnop") * 3 for _ in range(n)]
    shared = text(12)
    texts = {i: " ".join([*text(r.randrange(0, 20)), *(shared * r.randrange(0, 3)), *text(r.randrange(0, 9))]) for i in range(60)} | {100: None, 101: "", 102: "x " * 400, 103: "x " * 90}
    check_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("at", F.lit(1)), 10)


def test_repeated_ids_and_missing_ids_are_left_alone(spark):
    long = " ".join(map(str, range(80)))
    docs = spark.createDataFrame([(5, long), (5, long), (None, long), (9, long)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.remove_repeats(docs, keep_text=True).collect())
    assert got == [(0, 0), (5, 0), (5, 0), (9, 80)]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n, width", [(0, 3), (2, 3), (3, 3), (10, 1), (31, 7), (200, 31)])
def test_least_of_neighbours(n, width):
    x = np.random.default_rng(n).integers(0, 2**64, n, np.uint64, endpoint=False)
    assert substrings.sliding_min(x, width).tolist() == [x[k : k + width].min() for k in range(n - width + 1)]


def test_equal_windows_have_equal_keys():
    """And few keys a document: about one for a dozen windows."""
    r = random.Random(8)
    shared = [f"s{r.random()}" for _ in range(80)]
    texts = [" ".join([f"w{r.random()}" for _ in range(n)] + shared + [f"v{r.random()}" for _ in range(n)]).encode() for n in (0, 33, 700)]
    keys = {}
    for t in texts:
        found = substrings.Windows([t], 50)
        for h, k in zip(found.hashes()[0].tolist(), found.keys().tolist(), strict=True):
            assert keys.setdefault(h, k) == k
    assert 8 < len(found.start) / len(set(found.keys().tolist())) < 14


def test_sketch_never_loses_a_repeat():
    keys = np.random.default_rng(3).integers(0, 2**64, 5000, np.uint64, endpoint=False)
    for row in range(substrings.DEPTH):
        met = np.unique(substrings.cells(keys, row, 100_000))
        assert (substrings.unpacked(substrings.packed(met)) == met).all()
    bits = [np.zeros(100_000 // 8 + 8, np.uint8) for _ in range(substrings.DEPTH)]
    twice = np.concatenate([keys[:500], keys])
    for shard, _, more in substrings.partial_sketch(twice, 100_000, 4):
        row, k = divmod(shard, 4)
        c = substrings.unpacked(more) + k * 25_000
        np.bitwise_or.at(bits[row], c >> 3, (1 << (c & 7)).astype(np.uint8))
    found = substrings.estimated_repeated(bits, 100_000, keys)
    assert found[:500].all() and found[500:].mean() < 0.05


# --- nearest neighbours


def recall(table_, **options):
    got = {}
    for r in ann.search(table_, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = ann.exact_search(table_)
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    return sum(len(set(got[q]) & set(want[q])) for q in want) / max(1, sum(map(len, want.values())))


def test_search_of_embeddings(spark, sf_dir):
    assert recall(table(spark, sf_dir, "embeddings")) >= 0.9


def test_scores_order_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 16)) * rng.uniform(0.2, 3, (1200, 1))
    x[300:700] = x[300]  # a third of all rows alike
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)] + [(5000, None, "z"), (5020, [0.0] * 16, "z"), (5040, [float("nan")] * 16, "z"), (5060, [None] + [1.0] * 15, "z"), (None, [1.0] * 16, "z"), (3, x[3].tolist(), "z")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    assert recall(vectors) >= 0.9
    by_query = {}
    for r in ann.search(vectors).orderBy("query_id", "rank").collect():
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), rel=1e-12) and r["query_id"] != r["vec_id"]
        by_query.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert all(v == sorted(v) for v in by_query.values())


def test_small_tables(spark):
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(0, 30, 10)], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(vectors).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 10), (0, 2, 20), (20, 1, 10), (20, 2, 0)]
    assert ann.search(vectors.limit(0)).count() == 0


def test_search_among_hot_groups(spark, tmp_path):
    """Recall of every kind of query: of copies, of members of tight clusters, and of vectors that are spread out."""
    rng = np.random.default_rng(11)
    n, dim, every, top = 50_000, 64, 100, 20
    unit = lambda v: v / np.sqrt((v * v).sum(1))[:, None]
    kind = rng.choice(3, n, p=[0.33, 0.27, 0.4])
    x = unit(rng.normal(size=(n, dim)))
    centres = unit(rng.normal(size=(30, dim)))
    x[kind == 1] = unit(centres[rng.integers(0, 30, (kind == 1).sum())] + rng.normal(size=((kind == 1).sum(), dim)) * 0.01)
    x[kind == 0] = unit(x[kind == 0][:1] + rng.normal(size=((kind == 0).sum(), dim)) * 1e-3)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float64()))}), tmp_path / "v.parquet")
    got = {}
    for r in ann.search(spark.read.parquet(str(tmp_path / "v.parquet")), every=every, top=top).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = {0: [], 1: [], 2: []}
    for q in range(0, n, every):
        scores = x @ x[q]
        scores[q] = -2
        hits[kind[q]].append(len(got[q] & set(np.argpartition(-scores, top)[:top].tolist())) / top)
    assert {k: np.mean(v) for k, v in hits.items()} == {0: 1, 1: 1, 2: 1}

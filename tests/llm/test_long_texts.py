"""Very long texts: whole results, and memory in proportion to the text. Columns of clashing names, empty tables, repeated rows."""

import random
import tracemalloc

import numpy as np
import pytest

from strandlake.llm import html_diff, matroska, mixing, neardup, packing, quality, secretscan, substrings, toxicity
from strandlake.llm.registry import vocabulary

SIZE = 3_000_000


def long_text(seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 9))) for _ in range(SIZE // 6))


@pytest.fixture(scope="module")
def docs(spark):
    text = long_text(1)
    half = len(text) // 2
    changed = text[:half] + " you idiot " + text[half:] + " password = hJ8s0Kq2zPw9xLm4"
    rows = [(1, text, "en", "a", "x", 1), (2, changed, "en", "a", "y", 2), (3, "z" * SIZE, "en", "b", "z", 3), (4, "short text", "en", "b", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, sig string, n long").persist()


def test_long_texts_are_read_whole(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_id = lambda df: {r["doc_id"]: r for r in df.collect()}
    linked = by_id(neardup.deduplicate(docs))
    assert [linked[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 3, 4] and linked[1]["n_shingles"] > SIZE // 7 and linked[3]["n_shingles"] == 1
    cut = by_id(substrings.remove_repeats(docs))
    n = len(texts[1].split())
    assert cut[1]["n_removed"] == 0 and n - 50 <= cut[2]["n_removed"] <= n and n + 5 <= cut[2]["n_words"] <= n + 6  # a word may be cut in two
    spans = by_id(secretscan.scan(docs))
    assert spans[2]["n_assign"] == 1 and spans[2]["spans"].endswith(f":{len(texts[2])}") and spans[3]["spans"] == ""
    media = by_id(matroska.measure(docs))
    assert media[3]["n_bytes"] == SIZE and media[3]["payload_bytes"] == SIZE // 64 * 64 + 64 * (SIZE % 64 > 0)
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    scores = by_id(toxicity.classify(docs, none))
    assert scores[2]["score"] > 0.5 > 0.3 > scores[1]["score"]
    packed = {}
    for r in packing.pack(docs, vocabulary()).collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] >= packed[r["doc_id"]]
    assert packed[4] == 3
    assert by_id(mixing.mix_sizes(docs))[1]["size"] == n


@pytest.mark.parametrize(
    "work, most",
    [
        (lambda raw: quality.features([raw]), 40), (lambda raw: neardup.signatures(*neardup.shingle_sets([raw]), 1), 70), (lambda raw: substrings.Windows([raw], 50).keys(), 50),
        (lambda raw: substrings._cover(raw, np.zeros(1, np.int64), 50), 60), (lambda raw: matroska.demux(matroska.mux(matroska.padded(raw))), 12),
        (lambda raw: packing.Encoder.of(vocabulary()).encode([raw.decode()]), 30), (lambda raw: secretscan.find_spans(raw.decode()), 10),
    ],
)
def test_memory_is_in_proportion_to_a_text(work, most):
    raw = long_text(2).encode()
    work(raw[:1000])
    tracemalloc.start()
    work(raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < most * len(raw), peak / len(raw)


def test_columns_of_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 1, "x"), (1, "a b c", "s", 1, "x"), (None, None, None, None, None)], "doc_id long, text string, source string, id long, n_bytes string")
    for name in ("media", "feature", "key", "spans", "held_out", "h1", "keys", "of", "length", "start", "size", "f"):
        docs = docs.withColumn(name, docs["text"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for operator in (matroska.measure, secretscan.scan, neardup.deduplicate, substrings.remove_repeats, mixing.mix_sizes, lambda d: quality.classify(d, none), lambda d: toxicity.classify(d, none), lambda d: packing.pack(d, vocabulary())):
        rows = operator(docs).collect()
        assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None"] and len({tuple(v for k, v in r.asDict().items() if k not in ("sequence_id", "offset")) for r in rows}) == 2
        assert operator(docs.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "http://a.x/1", "<p>a</p>", "q", 1), (1, "http://a.x/1", "<p>a</p>", "q", 1), (2, None, None, None, None)], "page_id long, url string, html string, text string, gone long")
    assert sorted((r["page_id"], r["text"]) for r in html_diff.extract(pages).collect()) == [(1, "a"), (1, "a"), (2, "")]
    assert html_diff.extract(pages.limit(0)).count() == 0

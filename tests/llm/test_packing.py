"""Packing: ids against the tokenizer, every id in one piece, gapless sequences, little padding, and the cutting-stock solver."""

import random
import zlib

import numpy as np
import pytest

from strandlake.llm import packing
from strandlake.llm.common import table
from strandlake.llm.registry import vocabulary


def check(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary().path)
    tokenizer.encode_special_tokens = True
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    for own in places.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    return sum(r["length"] for r in rows) / (2048 * len(places))


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fill = check(packing.pack(docs, vocabulary()).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})
    assert fill > 0.97


def test_null_empty_long_and_repeated(spark):
    texts = {1: None, 2: "", 3: "word  \n x" * 3000, 4: "<|endoftext|> a", 5: " lead", 6: "trail "}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, offset int")
    rows = packing.pack(docs, vocabulary()).collect()
    check(rows, texts)
    assert packing.pack(docs.union(docs), vocabulary()).count() == 2 * len(rows)
    assert packing.pack(docs.limit(0), vocabulary()).count() == 0


def test_ranks_are_the_tokenizers():
    """Ids by ranks equal those of the tokenizer: on random texts, and on every code point beside letters, digits, spaces and itself."""
    e, r = packing.Encoder(vocabulary()), random.Random(5)
    texts = ["".join(r.choice("ab c'\n\t \x1cé1_. 　²½ßÇ😀") for _ in range(r.randrange(60))) for _ in range(800)] + ["<|endoftext|>", " it's  \n\n ", "x" * 5000]
    assert e.encode(texts) == e.plain(texts) == packing.Encoder(packing.Vocabulary(vocabulary().path)).encode(texts)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 50_000):
        texts = [f" a{c}b 1{c}{c} {c}." for c in points[k : k + 50_000]]
        assert e.encode(texts) == e.plain(texts)


def test_ranks_of_another_vocabulary_are_refused(tmp_path):
    import public_tokenizers

    for ranks, pattern in (("byte_bpe_multi_50k.tiktoken", vocabulary().pattern), ("byte_bpe_50k.tiktoken", r"\S+|\s+")):
        with pytest.raises(ValueError, match="is not the vocabulary"):
            packing.Encoder(packing.Vocabulary(vocabulary().path, public_tokenizers.path(ranks), pattern))
    with pytest.raises(ValueError, match="is not the vocabulary"):
        packing.Encoder(packing.Vocabulary(public_tokenizers.path("word_bpe_49k.json"), vocabulary().ranks, vocabulary().pattern))


@pytest.mark.parametrize("seed", range(4))
def test_patterns_hold_everything(seed):
    r = random.Random(seed)
    demand = {c: r.randrange(0, 400 // c + 2) for c in range(1, 65)}
    demand = {c: n for c, n in demand.items() if n}
    solved = packing.solve(demand, 64)
    assert all(sum(c * n for c, n in p.items()) <= 64 for p, _ in solved)
    assert all(sum(p.get(c, 0) * t for p, t in solved) >= n for c, n in demand.items())
    assert sum(t for _, t in solved) <= sum(c * n for c, n in demand.items()) / 64 * 1.03 + 2
    spans = sorted((c, a, b) for c, a, b, _, _ in packing.places(solved))
    for (c1, _, b1), (c2, a2, _) in zip(spans, spans[1:], strict=False):
        assert c1 != c2 or b1 == a2
    assert packing.solve({}, 64) == []


def test_sequences_are_padded(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    rows = packing.sequences(packing.pack(docs, vocabulary(), keep_ids=True)).collect()
    assert sum(r["n_tokens"] for r in rows) == 5 and all(len(r["ids"]) == 4 * 2048 or r["n_tokens"].bit_count() == 1 for r in rows)

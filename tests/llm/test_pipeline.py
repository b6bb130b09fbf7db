"""The pipeline: each stage's decisions take effect on what the one before kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import mixing, quality, secretscan
from strandlake.llm.common import table
from strandlake.llm.registry import queries


def test_stages(spark, sf_dir):
    from .test_dedup import brute_components

    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir).persist()
        kept[name] = docs.collect()
        if name != "pack_sequences":
            assert docs.columns == columns
        if name == "quality_gam":
            scores = quality.classify(before, table(spark, sf_dir, "labels"))
            assert {r["doc_id"] for r in kept[name]} == {r["doc_id"] for r in scores.collect() if r["score"] >= 0.5}
        if name == "minhash_near_dedup":
            parts = brute_components({r["doc_id"]: r["text"] for r in kept["quality_gam"]})
            assert sorted(r["doc_id"] for r in kept[name]) == sorted(i for i, (_, c) in parts.items() if i == c)
        if name == "secret_scan":
            was = {r["doc_id"]: r["text"] for r in kept["minhash_near_dedup"]}
            assert all(r["text"] == secretscan.redact(was[r["doc_id"]], secretscan.find_spans(was[r["doc_id"]])) and r["n_chars"] == len(r["text"]) for r in kept[name]) and len(was) == len(kept[name])
            assert not any(k != "guess" for r in kept[name] for _, k, _ in secretscan.find_spans(r["text"]))
        if name == "mix_sources":
            taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix_sizes(before).collect() if r["size"]}
            copies = {}
            for r in kept[name]:
                copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
            assert {k: v for k, v in taken.items() if v} == {k: v for k, v in copies.items() if taken.get(k)}
        if name == "pack_sequences":
            texts = {r["doc_id"]: r["text"] for r in kept["mix_sources"]}
            seen = {}
            for r in kept[name]:
                seen.setdefault((r["doc_id"], r["start"]), []).append(r)
            assert all(len(v) == copies[k[0]] for k, v in seen.items())
            assert set(texts) == {k[0] for k in seen} and all(r["offset"] + r["length"] <= 2048 for r in kept[name])


def test_run_and_registry(spark, sf_dir):
    names = sorted(n.split("_")[0] for n in queries())
    assert names == sorted(f"op{k}" for k in range(1, 11))
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, and names that the stages use themselves."""
    long = " ".join(f"word{k % 977} of {k}" for k in range(60_000)) + " password = hJ8s0Kq2zPw9xLm4"
    good = "The quick brown fox jumps over the lazy dog, and then it rests in the shade of a tree for some time."
    rows = [
        (1, good, "en", "a", 100, 1, "x"), (1, good, "en", "a", 100, 1, "x"), (2, good + " ", "en", "b", 101, 2, None), (3, None, None, None, None, None, None), (None, good, "en", "a", 100, 3, "y"),
        (None, None, None, None, None, None, None), (4, "", "en", "a", 0, 4, "z"), (5, long, "en", "b", len(long), 5, "z"), (6, long, "en", "b", len(long), 5, "z"), (7, "api_key: 0123456789abcdef0123456789abcdef", "en", None, 1, 1, "q"),
        (4, "another text with the id of an empty one", "de", "c", 40, 4, "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id long, copies string")
    for name in ("key", "c0", "family", "_mix_copy", "score"):
        docs = docs.withColumn(name, F.lit(name))
    return docs


def test_odd_rows_in_every_stage(spark, sf_dir):
    docs = odd_documents(spark)
    columns, counts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf_dir).persist()
        after = docs.collect()
        counts[name] = len(after)
        if name == "pack_sequences":
            assert sum(r["length"] for r in after if r["start"] == 0) > 0 and {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
            break
        assert docs.columns == columns and all(r["key"] == "key" and r["_mix_copy"] == "_mix_copy" for r in after)
        if name == "quality_gam":  # what is judged here is the next stages' part; keep all rows for them
            assert {r["text"] for r in after} <= {r["text"] for r in before}
            docs = odd_documents(spark)
        if name == "minhash_near_dedup":
            ids = sorted(r["doc_id"] or 0 for r in after)
            assert ids == [0, 0, 1, 3, 4, 5, 7]  # of a repeated id one row stays; the copies 2 and 6 go
        if name == "secret_scan":
            assert len(after) == len(before) and all("hJ8s0Kq2zPw9xLm4" not in (r["text"] or "") and r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)
            assert [r["text"] for r in after if r["doc_id"] == 7] == ["[SECRET]"]
    assert counts["secret_scan"] == counts["minhash_near_dedup"]


def test_empty_table_in_every_stage(spark, sf_dir):
    docs = odd_documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0 and (name == "pack_sequences" or out.columns == docs.columns)

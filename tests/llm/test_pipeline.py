"""The pipeline's stages, each on what its predecessor kept."""

import collections
import re

import __spark_entry__
import corpus_pipeline
from geoloom.llm.common import scratch_path
from geoloom.llm.quality_model import quality_scores
from geoloom.llm.secret_scan import masked, secret_spans
from test_operators import brute_contaminated, brute_ids, shingle_set, similar_groups


def test_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "near-dedup", "decontamination", "secret scan", "packing"]
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        path = scratch_path(spark, "test-stage")
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        kept.append(docs.count())
    assert kept[0] > kept[1] > kept[2] >= kept[3] == kept[4] > kept[0] / 2
    assert docs.select("text").distinct().count() == docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_result_against_brute_force(spark, data):
    """Scores and automata are the operators' own; what they decide is composed by hand."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality_scores(docs, spark.read.parquet(f"{data}/labels.parquet")).where("predicted = 1").collect()}
    ids = sorted(i for i in texts if i in good)
    group = similar_groups([shingle_set(texts[i]) for i in ids])
    first = {}
    for i, g in zip(ids, group, strict=True):
        first.setdefault(g, i)
    kept = sorted(first.values())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute_contaminated([(i, texts[i]) for i in kept], items)}
    kept = [i for i in kept if i not in leaks]
    table = spark.createDataFrame([(i, texts[i]) for i in kept], "doc_id long, text string")
    spans = {r["doc_id"]: [s.asDict() for s in r["spans"]] for r in secret_spans(table).collect()}
    want = {i: brute_ids(masked(texts[i] or "", spans[i], "[secret]"), 2) for i in kept}
    held = collections.defaultdict(list)
    for r in sorted(corpus_pipeline.run(spark, data).collect(), key=lambda r: r["start"]):
        assert len(want[r["doc_id"]]) == r["doc_tokens"] and len(r["ids"]) == r["length"] and r["start"] == len(held[r["doc_id"]])
        held[r["doc_id"]] += r["ids"]
    assert held == want
    assert not any(re.search(r"AKIA[A-Z0-9]{14}", masked(texts[i] or "", spans[i], "[secret]")) for i in kept)


def test_registered():
    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in found} and "pipeline" in found

"""Stages on a small table: columns, decisions, whole results."""

import corpus_pipeline
import pyarrow as pa
import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    base = [" ".join(f"{a}{b}{c}word" for b in "abcdefgh" for c in "xyz") for a in "pqrstuvw"]
    texts = []
    for t in base:
        w = [f"{x}{k}" for k in range(4) for x in t.split()]
        texts += [" ".join(w), " ".join(w), " ".join(w[:-1] + ["changed"])]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(100, None, None, None, None), (101, "too short", "en", "s", 9)]
    return spark.createDataFrame(rows, DOC)


def test_stages(spark, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.dtypes == docs.dtypes, name
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 24, 3))
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, "")
    assert {r["doc_id"] for r in packed.collect()} == set(range(0, 24, 3))


def test_empty(spark, docs):
    d = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, "")
    assert d.count() == 0


def test_null_and_repeated_ids(spark, docs):
    """Every row is judged by itself: repeated rows, several rows of an id, none."""
    good = {r["doc_id"]: r["text"] for r in docs.filter("doc_id < 24").collect()}
    rows = [(i, t, "en", "s", len(t)) for i, t in good.items()]
    rows += [(0, "too short", "en", "s", 9), (None, "too short", "en", "s", 9), (None, good[3], "en", "s", 1), (9, good[9], "en", "s", len(good[9])), (50, good[6], "en", "s", 2)]
    fresh = " ".join(f"{x}{k}fresh" for k in range(9) for x in "abcdefghij")
    rows += [(None, fresh, "en", "s", 3)] * 3 + [(3, fresh + " more", "en", "s", 4)]
    d = spark.createDataFrame(rows, DOC).repartition(3)
    d = corpus_pipeline.quality(spark, d, "")
    assert d.count() == len(rows) - 2 and not d.filter("text = 'too short'").count()
    d = corpus_pipeline.language(spark, d, "")
    assert d.count() == len(rows) - 2
    d = corpus_pipeline.near_duplicates(spark, d, "")
    assert sorted((r["doc_id"], r["n_chars"]) for r in d.collect()) == sorted([*((i, len(good[i])) for i in range(0, 24, 3)), (3, 4)])
    assert d.dtypes == docs.dtypes


def test_texts_go_to_workers_in_slices(spark, docs, monkeypatch):
    """What a worker gets at once is bounded by bytes, not only by Spark's 10,000 rows."""
    texts = docs.limit(24).crossJoin(spark.range(60)).drop("id").coalesce(1)
    size = corpus_pipeline.SLICE_BYTES // 16

    def sent(d, *_):
        got = d.select("text").mapInArrow(lambda batches: (pa.record_batch({"bytes": [b.nbytes]}) for b in batches), "bytes long")
        return corpus_pipeline.written(got)

    monkeypatch.setattr(corpus_pipeline, "BATCH_BYTES", size)
    monkeypatch.setattr(corpus_pipeline.packing, "pack_documents", sent)
    got = [r["bytes"] for r in corpus_pipeline.pack(spark, texts, "").collect()]
    assert sum(got) > 8 * size and max(got) < 2 * size


def test_near_duplicates_send_sets_with_a_passage_in_common_a_few_times(spark, monkeypatch):
    import random

    from fieldspark.llm import jaccard_join

    sent, written = {}, jaccard_join.written

    def counted(df, name="table"):
        out = written(df, name)
        sent[name] = out.count()
        return out

    for name, value in (("written", counted), ("BLOCK", 1000), ("LEAST_BLOCK", 1000)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(23)
    some = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage = some(70)
    texts = [" ".join(some(20) + passage + some(20)) for _ in range(150)]
    texts += [texts[0] + " more", texts[1]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == list(range(150))
    assert sent["blocks"] <= 3 * len(texts)

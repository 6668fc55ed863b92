"""Driver and executors give memory back before every stage of the pipeline, workers at the end of their tasks."""

import pyarrow as pa

import corpus_pipeline
from sparkloom.llm import components, language_id, sentencepiece_scan
from sparkloom.llm.queries import tokenizer_path


def test_the_jvm_trims_its_native_heap(spark):
    assert "native heap" in components.trim_native(spark)


def test_every_stage_tidies_first(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(components, "trim_native", lambda session: calls.append(session))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = len(calls)
        stage(spark, docs, "")
        assert len(calls) > before, i


def test_workers_of_pieces_and_language_trim(spark, monkeypatch):
    seen = []
    for module in (sentencepiece_scan, language_id):
        monkeypatch.setattr(module, "trimmed", lambda run: seen.append(run.__name__) or run)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    sentencepiece_scan.encode(docs, "unread")
    language_id.identify(docs, None)
    assert seen == ["small", "matrices", "traced", "finish", "run"]


def test_every_stage_shrinks_the_executors_first(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(corpus_pipeline, "shrink_executors", calls.append)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = len(calls)
        stage(spark, docs, "")
        assert len(calls) == before + 1, i


def test_executors_collect_their_garbage(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    before = sum(b.getCollectionCount() for b in beans())
    components.shrink_executors(spark)  # here the driver is the executor
    assert sum(b.getCollectionCount() for b in beans()) > before


def test_giant_documents_leave_the_workers_a_few_rows_at_a_time(spark, monkeypatch):
    """A task holds hundreds of chunks; their ids as Python objects took more memory than everything else in a worker."""
    runs = {}
    monkeypatch.setattr(sentencepiece_scan, "trimmed", lambda run: runs.setdefault(run.__name__, run))
    sentencepiece_scan.encode(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path())
    ids = sentencepiece_scan.Pieces(tokenizer_path()).lib.encode("some text")
    key = {"h": 1, "m": "m", "n_chars": 9}
    part = {"digest": 5, "power": 7, "ids": ids}
    whole = pa.RecordBatch.from_pylist([{"key": key, "c": [part | {"chunk_no": n} for n in range(k)]} for k in (1, 2, 3)])
    out = list(runs["finish"]([whole.slice(0, 0), whole]))
    assert [b.num_rows for b in out] == [1, 1, 1]
    assert [r["n_chunks"] for b in out for r in b.to_pylist()] == [1, 2, 3]
    assert [r["ids"] for b in out for r in b.to_pylist()] == [ids, ids * 2, ids * 3]
    assert [r["digest"] for b in out for r in b.to_pylist()] == [5, 5 * 7 + 5, (5 * 7 + 5) * 7 + 5]
    body = sentencepiece_scan.MARK + "some"
    chunk = {"key": key, "chunk_no": 0, "body": body, "lo": 0, "hi": len(body), "is_last": True, "left": 0, "right": 0}
    chunks = pa.RecordBatch.from_pylist([chunk] * 40)
    for name in ("matrices", "traced"):
        assert [b.num_rows for b in runs[name]([chunks])] == [16, 16, 8], name

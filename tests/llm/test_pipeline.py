import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from brackenlog.llm import pieces
from llm.test_text_operators import DOCS, corpus, frame

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect_and_handle_odd_rows(spark, tmp_path):
    rows = corpus(1, 80) + [(900, "1234 ...", "en", "s", 8), (901, None, "en", None, None)]
    docs, before = frame(spark, rows), None
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, None)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == COLUMNS, name
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        got = docs.collect()
        if name == "language id":
            assert not {900, 901} & {r.doc_id for r in got} and all(r.lang for r in got)
        if name == "near-duplicates":
            texts = [r.text.lower() for r in got if r.doc_id is not None]
            assert len(texts) == len(set(texts))
        if name == "repeated passages":
            assert sum("p3 p4 p5" in r.text for r in got) <= 1
            assert all(r.n_chars == len(r.text) for r in got)
        if name == "mix":
            assert {r.doc_id for r in got} <= before
        if name == "pieces":
            assert all(r.round_trip for r in got)
        before = {r.doc_id for r in got}


@pytest.mark.parametrize("n", range(5))
def test_empty_tables(spark, n):
    assert corpus_pipeline.STAGES[n][1](spark, frame(spark, []), None).count() == 0


def test_run_equals_the_stages(spark, tmp_path):
    rows = [(k, f"alpha{k} beta{k} gamma delta words{k} number {k}", "en", "s", 0) for k in range(12)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tool = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == 12 and all(tool.decode(r.ids).decode() == texts[r.doc_id] for r in got)
    assert DOCS.startswith("doc_id")


def test_stages_take_texts_in_small_batches_unless_the_session_has_a_bound(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = [(k, f"word{k} " * 3000, "en", "s", 0) for k in range(400)]  # 10 MB
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))

    def largest(batches):
        yield pa.RecordBatch.from_pydict({"n": [max((b.nbytes for b in batches), default=0)]}, pa.schema([("n", pa.int64())]))

    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, docs, None)
            assert max(r.n for r in docs.mapInArrow(largest, "n long").collect()) < 4 << 20, name
        spark.conf.set(key, "16m")
        stage(spark, docs, None)
        assert spark.conf.get(key) == "16m"
    finally:
        spark.conf.unset(key)


def test_a_worker_keeps_no_searched_segments_after_its_task(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = frame(spark, [(k, f"alpha{k} beta{k}", "en", "s", 0) for k in range(40)]).repartition(4)
    assert len(pieces.encode(docs, path).collect()) == 40

    def memos(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(len(v.memo) for v in pieces._loaded.values())]}, pa.schema([("n", pa.int64())]))

    assert {r.n for r in spark.range(0, 64, 1, 32).mapInArrow(memos, "n long").collect()} == {0}

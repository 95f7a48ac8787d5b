import pytest

from bytesift import registry
from bytesift.streaming import ingest


class Seen(Exception):
    pass


def files_of(spark, tmp_path, monkeypatch, query):
    """The files that a stream finds, and those of a batch."""

    def stream(spark, path, id_col, text_col, max_files):
        raise Seen(len(spark.read.parquet(path).inputFiles()), max_files, spark.read.parquet(path).count())

    monkeypatch.setattr(registry, "FILE_TEXT", 100, raising=False)
    monkeypatch.setattr(ingest, "table_stream", stream)
    rows = [(i, f"text {i % 150} " * 5) for i in range(2000)] + [(2001, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    with pytest.raises(Seen) as seen:
        registry.QUERIES[query](spark, str(tmp_path))
    return seen.value.args


def test_three_batches_grow_by_files(spark, tmp_path, monkeypatch):
    files, each, rows = files_of(spark, tmp_path, monkeypatch, "stream_ingest_counts")
    assert each > 1 and -(-files // each) == 3 and rows == 2001


def test_forty_batches_grow_by_files(spark, tmp_path, monkeypatch):
    files, each, rows = files_of(spark, tmp_path, monkeypatch, "stream_many_batches")
    assert each > 1 and -(-files // each) <= 40 and rows == 400

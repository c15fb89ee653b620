"""Registered queries in the form that grows with the input."""
from pyspark.sql import DataFrameWriter

import __spark_entry__ as entry


def test_vector_search_asks_for_every_hundredth_row(spark, tmp_path):
    rows = [(i, [float(i % 7 + 1), float(i % 5), float(i % 3)]) for i in range(1, 405)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["vector_search"](spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in got} == {100, 200, 300, 400} and len(got) == 20
    assert max(r["id"] for r in got) > 100


def test_pages_are_put_in_place_by_the_tasks(spark, tmp_path, monkeypatch):
    """Not renamed one by one on the driver once all are written."""
    spark.createDataFrame([(i, "a text", "en", "s", 6) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    told, write = [], DataFrameWriter.options
    monkeypatch.setattr(DataFrameWriter, "options", lambda self, **kept: told.append(kept) or write(self, **kept))
    got = entry.queries()["scan_corpus"](spark, str(tmp_path)).collect()
    assert len(got) == 20 and all(r["named"] for r in got)
    assert {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": "2"} in told

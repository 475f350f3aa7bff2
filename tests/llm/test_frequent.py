"""Frequent histories are fitted from all training texts, whichever shard scores them."""

from pyspark.sql import functions as F

from shalebed.llm import maxent


def test_equal_texts_score_alike_in_all_shards(spark, monkeypatch):
    rows = [(i, f"the cat {i % 9} sat on the mat with the {i % 5} others") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r["doc_id"]: r["score"] for r in maxent.score_documents(docs).collect()}
    monkeypatch.setattr(maxent, "SHARE", 40)
    found = maxent.score_documents(docs)
    assert found.count() == 900
    spread = found.join(docs, "doc_id").groupBy("text").agg((F.max("score") - F.min("score")).alias("d")).agg(F.max("d")).first()[0]
    assert spread < 1e-4
    assert all(abs(whole[r["doc_id"]] - r["score"]) < 3 for r in found.collect())

"""What the driver holds of a language model."""

from __future__ import annotations

from assayframe.llm import perplexity


def test_the_language_model_is_sent_once_and_no_table_of_it_is_broadcast_by_a_join(spark, monkeypatch):
    docs = spark.createDataFrame([(n, "en", f"the cat {n} sat on mat {n % 7}") for n in range(60)], "doc_id long, lang string, text string")
    sent = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    assert perplexity.judge(docs, docs.select("doc_id")).count() == 60
    assert sum(isinstance(value, perplexity.Shards) for value in sent) == 1
    plan = perplexity.train(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Union" not in plan

"""The model of personal data counts every span of every document."""

from pyspark.sql import functions as F

from millrace.llm import pii


def test_all_spans_are_counted(spark, monkeypatch):
    seen = []
    views, calibrated = pii.TwoViews, pii._calibrated
    monkeypatch.setattr(pii, "TwoViews", lambda x, passes, free, n: (seen.append((len(n), n.sum())), views(x, passes, free, n))[1])
    monkeypatch.setattr(pii, "_calibrated", lambda raw, y, n: (seen.append((len(n), n.sum())), calibrated(raw, y, n))[1])
    text = "mail a.b@c.de or x@y.org, host 10.0.0.1"
    docs = spark.range(45_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    model = pii.fit(docs)
    one = list(pii._examples(text))
    halves = docs.groupBy(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).alias("fold")).count().collect()
    fold = {r["fold"]: r["count"] for r in halves}
    assert [total for _, total in seen] == [len(one) * fold[0], sum(passes for _, passes, _, _ in one) * fold[1]]
    assert all(rows <= len(one) for rows, _ in seen) and set(model) == {0, 1, 2, 3}

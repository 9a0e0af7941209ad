"""Relevance metrics and traces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import null_as_empty, plain_symbols


def metrics(results: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Recall, MRR and NDCG by query at each cutoff.

    ``results``: query_id, key, rank; ``qrels``: query_id, key (relevant ones). ``recall_raw`` counts
    repeated keys, so it may exceed 1; ``recall`` counts each once.
    """
    relevant = qrels.select("query_id", "key").distinct()
    totals = relevant.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    flag = relevant.withColumn("rel", F.lit(1))
    judged = results.join(flag, ["query_id", "key"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    aggs = []
    for k in cutoffs:
        top = F.col("rank") <= k
        aggs += [
            F.sum(F.when(top, F.col("rel")).otherwise(0)).alias(f"hits_{k}"),
            F.countDistinct(F.when(top & (F.col("rel") == 1), F.col("key"))).alias(f"own_{k}"),
            F.coalesce(F.max(F.when(top & (F.col("rel") == 1), 1 / F.col("rank"))), F.lit(0.0)).alias(f"mrr_{k}"),
            F.sum(F.when(top, gain).otherwise(0.0)).alias(f"dcg_{k}"),
        ]
    found = judged.groupBy("query_id").agg(*aggs).join(totals, "query_id")
    out = [F.col("query_id")]
    for k in cutoffs:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        out += [
            F.round(F.col(f"hits_{k}") / F.col("n_rel"), 4).alias(f"recall_raw_{k}"),
            F.round(F.col(f"own_{k}") / F.col("n_rel"), 4).alias(f"recall_{k}"),
            F.round(f"mrr_{k}", 4).alias(f"mrr_{k}"),
            F.round(F.col(f"dcg_{k}") / ideal, 4).alias(f"ndcg_{k}"),
        ]
    return found.select(*out)


def exact_percentile(rows: DataFrame, value: str, group: list[str], share: float = 0.95, margin: float = 0.002) -> DataFrame:
    """``group`` and ``value``: the percentile, linear between neighbours, of any number of rows.

    An approximate summary bounds it from both sides; values below are counted, and only those between are sorted: about two
    ``margin`` of a group.
    """
    some = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    about = F.percentile_approx("_v", [max(share - margin, 0.0), min(share + margin, 1.0)], 10_000)
    few = F.count("*") * margin < 2  # so few that both neighbours may lie outside
    bounds = some.groupBy(*group).agg(F.when(few, F.array(F.min("_v"), F.max("_v"))).otherwise(about).alias("_b"), F.count("*").alias("_n"))
    placed = some.join(bounds, group) if group else some.crossJoin(F.broadcast(bounds))
    low = F.col("_b")[0]
    below = placed.groupBy(*group).agg(F.count_if(F.col("_v") < low).alias("_below"))
    middle = placed.where((F.col("_v") >= low) & (F.col("_v") <= F.col("_b")[1]))
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("_v")) - 1
    ranked = middle.withColumn("_i", nth).join(below, group) if group else middle.withColumn("_i", nth).crossJoin(F.broadcast(below))
    at = share * (F.col("_n") - 1)
    place = F.col("_i") + F.col("_below")
    first, second = F.max(F.when(place == F.floor(at), F.col("_v"))), F.max(F.when(place == F.ceil(at), F.col("_v")))
    part = F.first(at - F.floor(at))
    return ranked.groupBy(*group).agg((first + (second - first) * part).alias(value))


def trace_summary(traces: DataFrame, latency: str, group: list[str]) -> DataFrame:
    """Count, mean and 95th percentile (linear between neighbours) of the latency."""
    means = traces.groupBy(*group).agg(F.count("*").alias("n"), F.round(F.avg(latency), 4).alias("mean_latency"))
    top = exact_percentile(traces, latency, group).select(*group, F.round(latency, 4).alias("p95_latency"))
    return means.join(top, group, "left")


def append_traces(traces: DataFrame, path: str) -> None:
    """Add traces (``query, num_results, latency_ms, top_scores, timestamp`` and metrics) to the stored ones."""
    traces.write.mode("append").parquet(path)


def rerank_pool(candidates: DataFrame, order: DataFrame, pool: int = 15) -> DataFrame:
    """Candidates of the pool by a reranker's places, then the others by score. ``order``: query_id, chunk_id, place from 1."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    ranked = candidates.withColumn("rn", F.row_number().over(w)).join(order, ["query_id", "chunk_id"], "left")
    place = F.when(F.col("rn") <= pool, F.coalesce("place", "rn")).otherwise(pool + F.col("rn"))
    final = Window.partitionBy("query_id").orderBy(place, "rn")
    return ranked.withColumn("final_rank", F.row_number().over(final).cast("long")).drop("rn", "place")


def blend(judged: str, score: str, share: float = 0.7):
    """Pointwise rerank: ``share`` of the judge's value (0.5 if it gave none).

    The 1e-9 rounds up halves that the sum's last bits put just below.
    """
    return F.round(share * F.coalesce(judged, F.lit(0.5)) + (1 - share) * F.coalesce(score, F.lit(0.0)) + 1e-9, 4)


def listwise_rerank(candidates: DataFrame, ranker, pool: int = 15) -> DataFrame:
    """A pluggable ranker orders each question's pool; a wrong answer leaves the order by score.

    ``ranker(question, texts) -> list of places``; ``candidates``: query_id, question, chunk_id, score, text.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "chunk_id"], ascending=[False, True])
        head = group.head(pool)
        try:
            places = list(ranker(head["question"].iloc[0], head["text"].tolist()))
        except Exception:  # a plug may fail in any way; the order by score stands then
            places = []
        if sorted(places) != list(range(len(head))):
            places = list(range(len(head)))
        rows = [*(head.iloc[p] for p in places), *(group.iloc[i] for i in range(len(head), len(group)))]
        return pd.DataFrame({"query_id": [r["query_id"] for r in rows], "chunk_id": [r["chunk_id"] for r in rows], "final_rank": range(1, len(rows) + 1)})

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    bounded = candidates.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= pool)  # a group is at most the pool
    head = bounded.drop("_rn").groupBy("query_id").applyInPandas(run, "query_id long, chunk_id long, final_rank long")
    rest = candidates.withColumn("final_rank", F.row_number().over(w).cast("long")).where(F.col("final_rank") > pool).select("query_id", "chunk_id", "final_rank")
    return head.unionByName(rest)


def overlap_ranker(question: str, texts: list[str]) -> list[int]:
    """The offline ranker: by the number of the question's words in a text, ties in the given order."""
    words = set(question.lower().split())
    return sorted(range(len(texts)), key=lambda i: -len(words & set(texts[i].lower().split())))


def cross_encoded(candidates: DataFrame, scorer, k: int = 10, limit: int = 1200) -> DataFrame:
    """Candidates ordered by a plugged model over (question, text) pairs: ``rerank_score`` to 4 places, the ``k`` best of each question.

    ``scorer(questions, texts) -> scores``; texts are freed of symbols and cut first. ``candidates``: query_id, question, chunk_id, text.
    """
    def run(questions: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(questions.tolist(), texts.tolist())).astype(float)

    clean = F.substring(plain_symbols(null_as_empty(F.col("text"))), 1, limit)
    scored = candidates.withColumn("rerank_score", F.round(F.pandas_udf(run, "double")(F.col("question"), clean), 4))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)

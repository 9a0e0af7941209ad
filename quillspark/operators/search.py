"""Scoring, top-k, fusion: many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import tokenize
from quillspark.shared import written

#: Fixed values of the Okapi formula.
K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass(frozen=True)
class Bm25Index:
    """Term statistics of a corpus. Filters apply to the scored chunks only, never to these."""

    chunks: DataFrame  # chunk_id, tokens, dl and the metadata columns
    idf: DataFrame  # term, df, idf
    stats: DataFrame  # one row: n_docs, avgdl

    def stored(self) -> "Bm25Index":
        """The same index as tables in the shared folder: a corpus is tokenised once, however many searches follow."""
        chunks = written(self.chunks, "tokens")
        return Bm25Index(chunks, written(_idf(chunks), "idf"), written(_stats(chunks), "stats"))


def bm25_index(chunks: DataFrame, text: str = "text") -> Bm25Index:
    """``chunks`` has a unique ``chunk_id`` and a text column."""
    tokens = tokenize(F.col(text))
    chunks = chunks.withColumn("tokens", tokens).withColumn("dl", F.size("tokens").cast("long"))
    return Bm25Index(chunks, _idf(chunks), _stats(chunks))


def _stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def _idf(chunks: DataFrame) -> DataFrame:
    df = chunks.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = F.col("n_docs")
    # One row of statistics: a join with a single row moves nothing but that row.
    raw = df.crossJoin(F.broadcast(chunks.agg(F.count("*").alias("n_docs")))).withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg((F.avg("raw") * EPSILON).alias("least"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("least")).otherwise(F.col("raw")).alias("idf"))


def _wanted(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(index: Bm25Index, queries: DataFrame, where: Column | None = None) -> DataFrame:
    """``query_id, chunk_id, score`` of every pair with a common term. ``queries``: query_id, text.

    Term frequencies are counted for query terms alone, so the corpus's postings are never shuffled.
    """
    wanted = _wanted(queries)
    chunks = index.chunks if where is None else index.chunks.where(where)
    terms = wanted.select("term").distinct()
    tf = (
        chunks.select("chunk_id", "dl", F.explode("tokens").alias("term"))
        .join(terms, "term", "left_semi")
        .groupBy("chunk_id", "dl", "term")
        .agg(F.count("*").alias("tf"))
    )
    known = index.idf.join(terms, "term", "left_semi").crossJoin(F.broadcast(index.stats.select("avgdl")))
    hit = tf.join(known, "term").withColumn("w", F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    return hit.join(wanted, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("qtf") * F.col("w")).alias("score"))


def top_k(scores: DataFrame, k: int, score: str = "score", key: str = "chunk_id", digits: int = 6) -> DataFrame:
    """The k best by query and by score rounded to ``digits``, ties by the least key; adds ``rank`` from 1."""
    order = Window.partitionBy("query_id").orderBy(F.round(score, digits).desc(), F.col(key).asc())
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


class Best:
    """The k best (query, chunk, score) of what a task has seen, by score rounded to ``digits`` as in ``top_k``, ties by the least chunk."""

    def __init__(self, k: int, digits: int):
        self.k, self.unit = k, 10.0**digits
        self.query, self.chunk, self.score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)

    def add(self, queries: np.ndarray, chunks: np.ndarray, scores: np.ndarray) -> None:
        """A matrix of scores, queries by chunks; not-a-number stands for no pair."""
        rounded = self.rounded(scores)
        if scores.shape[1] > self.k:  # what is below a query's k-th value can't be among its best
            least = -np.partition(-np.nan_to_num(rounded, nan=-np.inf), self.k - 1, axis=1)[:, self.k - 1]
            keep = rounded >= least[:, None]
        else:
            keep = ~np.isnan(rounded)
        q, c = np.nonzero(keep & ~np.isnan(rounded))
        query, chunk, score = np.concatenate([self.query, queries[q]]), np.concatenate([self.chunk, chunks[c]]), np.concatenate([self.score, scores[q, c]])
        order = np.lexsort((chunk, -self.rounded(score), query))
        own = query[order]
        order = order[np.arange(len(own)) - np.searchsorted(own, own, side="left") < self.k]
        self.query, self.chunk, self.score = query[order], chunk[order], score[order]

    def rounded(self, x: np.ndarray) -> np.ndarray:
        return np.sign(x) * np.floor(np.abs(x) * self.unit + 0.5)  # halves up

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.query), pa.array(self.chunk), pa.array(self.score)], names=["query_id", "chunk_id", "score"])


def _is_long(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")


def bm25_best(index: Bm25Index, queries: DataFrame, k: int, where: Column | None = None, digits: int = 6, most_pairs: int = 500_000) -> DataFrame | None:
    """``query_id, chunk_id, score``: at least the k best by query, scored where the chunks are read; None if the queries are too many.

    The words of the queries with their weights go to the executors if there are at most ``most_pairs`` (query, word) pairs.
    A task counts these words in its chunks, multiplies the counts' weights with the queries and keeps k a query, so nothing but
    the tasks' best is shuffled. Beyond that size ``bm25_scores`` joins instead.
    """
    wanted = _wanted(queries.where("query_id is not null"))
    pairs = wanted.limit(most_pairs + 1).collect()
    if len(pairs) > most_pairs or not _is_long(queries, "query_id") or not _is_long(index.chunks, "chunk_id"):
        return None
    chunks = (index.chunks if where is None else index.chunks.where(where)).select(F.col("chunk_id").cast("long"), F.col("dl").cast("long"), "tokens")
    idf = {r["term"]: r["idf"] for r in index.idf.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi").collect()}
    avgdl = index.stats.first()["avgdl"]
    terms = sorted(idf)
    place = {t: i for i, t in enumerate(terms)}
    by_query: dict[int, list[tuple[int, int]]] = {}
    for r in pairs:
        if r["term"] in place:
            by_query.setdefault(r["query_id"], []).append((place[r["term"]], r["qtf"]))
    if not by_query:
        return None
    ids = np.array(sorted(by_query), dtype=np.int64)
    rows = np.repeat(np.arange(len(ids)), [len(by_query[i]) for i in ids.tolist()])
    cols, times = np.array([x for i in ids.tolist() for x in by_query[i]]).T
    weight = np.array([idf[t] for t in terms])
    shared = chunks.sparkSession.sparkContext.broadcast((ids, rows, cols, times * 1.0, weight, pa.array(terms)))

    def run(batches):
        ids, rows, cols, times, weight, terms = shared.value
        best, n_terms = Best(k, digits), len(weight)
        slices = []  # blocks of queries, each with the words it has
        for lo in range(0, len(ids), 256):
            part = (rows >= lo) & (rows < lo + 256)
            own, at = np.unique(cols[part], return_inverse=True)
            matrix = np.zeros((min(256, len(ids) - lo), len(own)))
            matrix[rows[part] - lo, at] = times[part]
            slices.append((ids[lo : lo + 256], own, matrix))
        step = max(16, min(1024, (2 << 20) // n_terms))
        for batch in batches:
            chunk, dl = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            tokens = batch.column(2)
            lengths = np.diff(tokens.offsets.to_numpy())
            found = pc.index_in(tokens.flatten(), value_set=terms)
            some = found.is_valid().to_numpy(zero_copy_only=False)
            word, owner = found.drop_null().to_numpy().astype(np.int64), np.repeat(np.arange(len(chunk)), lengths)[some]
            key, tf = np.unique(owner * n_terms + word, return_counts=True)
            owner, word = key // n_terms, key % n_terms
            part = weight[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[owner] / avgdl))
            for lo in range(0, len(chunk), step):
                a, b = np.searchsorted(owner, (lo, lo + step))
                if a == b:
                    continue
                present = np.zeros((min(step, len(chunk) - lo), n_terms))
                present[owner[a:b] - lo, word[a:b]] = part[a:b]
                for who, own, matrix in slices:
                    scores = matrix @ present[:, own].T
                    best.add(who, chunk[lo : lo + step], np.where(best.rounded(scores) == 0, np.nan, scores))
        if len(best.query):
            yield best.rows()

    return chunks.mapInArrow(run, "query_id long, chunk_id long, score double")


def bm25_search(index: Bm25Index, queries: DataFrame, k: int = 30, where: Column | None = None, keep_zero: bool = False) -> DataFrame:
    """Top k chunks by query. ``keep_zero`` fills up with chunks that share no term, by least id."""
    if keep_zero:
        scores = bm25_scores(index, queries, where).where("round(score, 6) <> 0")
        chunks = index.chunks if where is None else index.chunks.where(where)
        pairs = queries.select("query_id").crossJoin(F.broadcast(chunks.select("chunk_id").orderBy("chunk_id").limit(k)))
        return top_k(scores.unionByName(pairs.join(scores, ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))), k)
    best = bm25_best(index, queries, k, where)
    if best is None:
        return top_k(bm25_scores(index, queries, where).where("round(score, 6) <> 0"), k)
    return top_k(best, k)


def _packed(vectors: DataFrame, key: str, rows: int) -> DataFrame:
    """``ids, vectors``: up to ``rows`` vectors a row, as little-endian bytes."""

    def run(batches):
        ids, held = [], []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).astype("<i8").tobytes()]), pa.array([np.concatenate(held).astype("<f4").tobytes()])], names=["ids", "vectors"])

        n = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                held.append(part.column(1).flatten().to_numpy(zero_copy_only=False))
                n += part.num_rows
                if n >= rows:
                    yield row()
                    ids, held, n = [], [], 0
        if n:
            yield row()

    return vectors.select(F.col(key).cast("long"), F.col("embedding").cast("array<float>")).where("embedding is not null").mapInArrow(run, "ids binary, vectors binary")


def vector_search(corpus: DataFrame, queries: DataFrame, k: int = 30, block: int = 1024, digits: int = 6, most_held: int = 4 << 20) -> DataFrame:
    """Exact inner-product search. ``corpus``: chunk_id long, embedding; ``queries``: query_id long, embedding.

    Queries and corpus are packed into rows of ``block`` vectors; every packed row of the corpus meets every block of queries,
    and a task keeps k candidates a query, so only ``k x queries`` rows a task are shuffled; the driver holds none of the vectors.
    Tasks and the last ranking compare scores rounded to the same ``digits``.
    """
    asked = _packed(queries.where("query_id is not null"), "query_id", block).toDF("query_ids", "query_vectors")
    both = _packed(corpus, "chunk_id", 4 * block).crossJoin(asked)  # a query set against all rows, in blocks

    def run(batches):
        best = Best(k, digits)
        for batch in batches:
            for chunks, vectors, who, asked in zip(*(c.to_pylist() for c in batch.columns)):
                chunks, who = np.frombuffer(chunks, "<i8"), np.frombuffer(who, "<i8")
                left, right = np.frombuffer(asked, "<f4").reshape(len(who), -1).astype(np.float64), np.frombuffer(vectors, "<f4").reshape(len(chunks), -1).astype(np.float64)
                best.add(who, chunks, left @ right.T)
                if len(best.query) > most_held:
                    yield best.rows()
                    best = Best(k, digits)
        if len(best.query):
            yield best.rows()

    return top_k(both.mapInArrow(run, "query_id long, chunk_id long, score double"), k, digits=digits)


def merge_channels(vector: DataFrame, bm25: DataFrame) -> DataFrame:
    """``query_id, chunk_id, vector_score, bm25_score``: the greatest per channel, at least 0, absent as 0."""
    zero = F.lit(0.0)
    both = vector.select("query_id", "chunk_id", F.col("score").alias("vector_score"), zero.alias("bm25_score")).unionByName(
        bm25.select("query_id", "chunk_id", zero.alias("vector_score"), F.col("score").alias("bm25_score"))
    )
    return both.groupBy("query_id", "chunk_id").agg(
        F.greatest(F.max("vector_score"), zero).alias("vector_score"), F.greatest(F.max("bm25_score"), zero).alias("bm25_score")
    )


def minmax_fuse(candidates: DataFrame, alpha: float = 0.6) -> DataFrame:
    """Adds ``score``: each channel scaled to 0..1 by query (all equal: 1), ``alpha`` of it the vector's."""
    w = Window.partitionBy("query_id")

    def scaled(name: str) -> Column:
        lo, hi = F.min(name).over(w), F.max(name).over(w)
        return F.when(hi == lo, 1.0).otherwise((F.col(name) - lo) / (hi - lo))

    return candidates.withColumn("score", F.round(alpha * scaled("vector_score") + (1 - alpha) * scaled("bm25_score"), 4))


def hybrid_search(index: Bm25Index, corpus: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int = 10, pool: int = 30, alpha: float = 0.6) -> DataFrame:
    """Both channels' top ``pool``, merged, fused, cut to the top ``k``."""
    bm25 = bm25_search(index, queries, pool).select("query_id", "chunk_id", F.round("score", 6).alias("score"))
    vector = vector_search(corpus, query_vectors, pool).select("query_id", "chunk_id", F.round("score", 6).alias("score"))
    fused = minmax_fuse(merge_channels(vector, bm25), alpha)
    return top_k(fused, k)

"""Retrieval as a question meets it: references, routing, the strictest filter with a hit, both channels, boost, fusion, bundling.

Many questions are answered at once. Those that a paper, a section or a table narrows down are scored on the pairs that
their filter leaves; all others share one scan of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import vectors as vx
from quillspark.functions.text import tokenize
from quillspark.operators import dialogue, quality_of_search, relational, routing, search
from quillspark.operators.search import B, K1, Bm25Index
from quillspark.shared import written

#: Most rewrites of a question that search, itself among them.
MOST_REWRITES = 5
BUNDLED = ("dataset", "experiment", "config")


def understood(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """``query_id, text, intent, source, section_ref, table_ref, narrowed``: what a question asks for.

    ``sources``: source, title, archive_id, idx. A file that the words of the question name wins over one that it
    refers to. ``narrowed``: whether it refers to a paper or a section, found or not.
    """
    refs = questions.select("query_id", "text", routing.intent(F.col("text")).alias("intent"), *[c.alias(n) for n, c in routing.references(F.col("text")).items()])
    routed = routing.filename_router(questions, sources.select("source").distinct()).select("query_id", F.col("source").alias("routed"))
    named = relational.keyword_source(refs.where("paper_ref is not null").select(F.col("paper_ref").alias("keyword")).distinct(), sources)
    joined = refs.join(routed, "query_id", "left").join(named.withColumnsRenamed({"keyword": "paper_ref", "source": "named"}), "paper_ref", "left")
    narrowed = F.col("paper_ref").isNotNull() | F.col("section_ref").isNotNull()
    return joined.select("query_id", "text", "intent", F.coalesce("routed", "named").alias("source"), "section_ref", "table_ref", narrowed.alias("narrowed"))


def narrowed_pairs(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, chunk_id, tier``: for each question that a filter narrows down the chunks of its strictest filter with a hit.

    Tiers: 0 table in paper, 1 table, 2 section in paper, 3 paper, 4 section. A question for a table never leaves
    it, one for a paper that exists is never answered from others.
    """
    at = chunks.select("chunk_id", "source", "section_id", "table_id", "is_table")
    own = asked.select("query_id", F.col("source").alias("want"), "section_ref", "table_ref")
    table = own.where("table_ref is not null").join(at.where("is_table"), F.col("table_ref") == F.regexp_replace("table_id", r"\.$", ""))
    table = table.withColumn("tier", F.when(F.col("want").isNull() | (F.col("want") == F.col("source")), 0).otherwise(1))
    paper = own.where("table_ref is null and want is not null").join(at, F.col("want") == F.col("source"))
    paper = paper.withColumn("tier", F.when(F.col("section_id").startswith(F.col("section_ref")), 2).otherwise(3))
    # A prefix test as an equality: sections of the wanted length.
    sections = own.where("table_ref is null and want is null and section_ref is not null")
    starts = at.where("section_id <> ''").withColumn("start", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("section_id")), lambda n: F.substring("section_id", F.lit(1), n))))
    section = sections.join(starts, F.col("section_ref") == F.col("start")).withColumn("tier", F.lit(4))
    every = [x.select("query_id", "chunk_id", "tier") for x in (table, paper, section)]
    all_pairs = every[0].unionByName(every[1]).unionByName(every[2])
    best = all_pairs.groupBy("query_id").agg(F.min("tier").alias("tier"))
    return all_pairs.join(best, ["query_id", "tier"]).select("query_id", "chunk_id", "tier")


def _pair_scores(index: Bm25Index, vectors: DataFrame, pairs: DataFrame, variants: DataFrame, query_vectors: DataFrame, pool: int) -> tuple[DataFrame, DataFrame]:
    """Each channel's best ``pool`` of the given pairs by question and rewrite: ``query_id, pos, chunk_id, score``."""
    terms = variants.select("query_id", "pos", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", "pos", "term").agg(F.count("*").alias("qtf"))
    needed = index.chunks.select("chunk_id", "dl", "tokens").join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi")
    tf = needed.select("chunk_id", "dl", F.explode("tokens").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    known = index.idf.crossJoin(F.broadcast(index.stats.select("avgdl")))  # one row of statistics
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hit = pairs.select("query_id", "chunk_id").join(tf, "chunk_id").join(terms, ["query_id", "term"]).join(known, "term")
    bm25 = hit.groupBy("query_id", "pos", "chunk_id").agg(F.sum(F.col("qtf") * weight).alias("score"))
    close = pairs.select("query_id", "chunk_id").join(query_vectors.withColumnRenamed("embedding", "q"), "query_id").join(vectors.select("chunk_id", F.col("embedding").alias("c")), "chunk_id")
    vector = close.select("query_id", "chunk_id", vx.dot(F.col("q"), F.col("c")).alias("score"))
    vector = vector.join(variants.select("query_id", "pos"), "query_id").select("query_id", "pos", "chunk_id", "score")

    def best(scores: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id", "pos").orderBy(F.round("score", 6).desc(), "chunk_id")
        return scores.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= pool).drop("rn")

    return best(vector), best(bm25.where("round(score, 6) <> 0"))


def retrieve(index: Bm25Index, vectors: DataFrame, questions: DataFrame, query_vectors: DataFrame, rewrites: DataFrame | None = None, k: int = 10, pool: int = 30, alpha: float = 0.6, ranker: Callable | None = None) -> DataFrame:
    """``query_id, chunk_id, score, rank, tier`` of every question's best chunks; tier 5 is the whole corpus.

    ``index.chunks`` has ``chunk_id, source, title, archive_id, section_id, section_title, table_id, is_table, idx, text``; ``vectors``:
    chunk_id, embedding, of these chunks; ``questions``: query_id (a long below 2**59), text; ``query_vectors``: query_id, embedding, which stands for the rewrites too.
    ``rewrites``: query_id, pos (from 1), text; without them the questions with the section words of their intent. A
    question that is narrowed down is not rewritten. A ``ranker`` orders the first 15 (``listwise_rerank``).
    """
    chunks = index.chunks
    # What is read again and again is written once: the questions' tables, and each channel's few candidates.
    sources = chunks.groupBy("source").agg(F.min_by("title", "idx").alias("title"), F.min_by("archive_id", "idx").alias("archive_id"), F.min("idx").alias("idx"))
    asked = written(understood(questions, sources), "asked")
    if rewrites is None:
        rewrites = questions.select("query_id", F.posexplode(dialogue.expansions(F.col("text"))).alias("pos", "text")).withColumn("pos", F.col("pos") + 1)
    free = rewrites.join(asked.where("not narrowed").select("query_id"), "query_id", "left_semi")
    every = asked.select("query_id", F.lit(0).alias("pos"), "text").unionByName(free.select("query_id", F.col("pos").cast("int").alias("pos"), "text"))
    variants = written(dialogue.distinct_rewrites(every, MOST_REWRITES).select("query_id", F.col("place").cast("int").alias("pos"), "text"), "variants")
    pairs = written(narrowed_pairs(asked, chunks), "pairs")
    wide = written(asked.where("table_ref is null and source is null").join(pairs.select("query_id").distinct(), "query_id", "left_anti").select("query_id"), "wide")
    own_vectors = query_vectors.select("query_id", "embedding")
    near, lexical = _pair_scores(index, vectors, pairs, variants, own_vectors, pool)
    coded = variants.join(wide, "query_id", "left_semi").select((F.col("query_id") * 8 + F.col("pos")).alias("query_id"), "text")
    wide_lexical = search.bm25_search(index, coded, pool).select(F.floor(F.col("query_id") / 8).cast("long").alias("query_id"), F.pmod("query_id", F.lit(8)).cast("int").alias("pos"), "chunk_id", "score")
    wide_near = search.vector_search(vectors, own_vectors.join(wide, "query_id", "left_semi"), pool).select("query_id", "chunk_id", "score").join(variants.select("query_id", "pos"), "query_id")
    titles = chunks.select("chunk_id", "section_title")
    channel = {"v": near.unionByName(wide_near.select(near.columns)), "b": lexical.unionByName(wide_lexical.select(lexical.columns))}

    def boosted(scores: DataFrame) -> DataFrame:
        """The best score of a chunk over the rewrites, each boosted by what its section answers."""
        full = scores.join(titles, "chunk_id").join(variants, ["query_id", "pos"]).join(asked.select("query_id", "intent"), "query_id")
        boost = F.when(F.coalesce("section_title", F.lit("")) == "", 1.0).otherwise(routing.section_boost(F.col("text"), F.col("intent"), F.col("section_title")))
        return written(full.groupBy("query_id", "chunk_id").agg(F.max(F.round(F.col("score") * boost, 6)).alias("score")), "channel")

    fused = search.minmax_fuse(search.merge_channels(boosted(channel["v"]), boosted(channel["b"])), alpha).select("query_id", "chunk_id", "score")
    fused = written(fused, "fused")
    gate = asked.select("query_id", (F.col("intent").isin(*BUNDLED) & F.col("table_ref").isNull()).alias("bundle"))
    placed = chunks.where("source <> '' and section_id <> ''").select("chunk_id", "source", "section_id", F.coalesce("section_title", F.lit("")).alias("section_title"), "idx")
    gated = fused.join(gate, "query_id")
    bundled = relational.bundle_sections(gated.where("bundle").drop("bundle"), placed, ["source", "section_id"]).unionByName(gated.where("not bundle").drop("bundle"))
    told = bundled.join(chunks.select("chunk_id", "text", "idx", "table_id"), "chunk_id").where("trim(text) <> ''")
    told = relational.dedup_text(told, [F.col("score").desc(), F.col("idx")], ["query_id"])
    if ranker is None:
        ranked = told.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")).cast("long"))
    else:
        full = told.join(questions.select("query_id", F.col("text").alias("question")), "query_id")
        order = quality_of_search.listwise_rerank(full.select("query_id", "question", "chunk_id", "score", "text"), ranker)
        ranked = told.join(order.withColumnRenamed("final_rank", "rank"), ["query_id", "chunk_id"])
    tier = pairs.select("query_id", "tier").distinct()
    out = ranked.join(asked.select("query_id", "table_ref"), "query_id").join(tier, "query_id", "left")
    most = F.when(F.col("table_ref").isNotNull(), 1).otherwise(k)
    return out.where(F.col("rank") <= most).select("query_id", "chunk_id", "score", "rank", F.coalesce("tier", F.lit(5)).cast("long").alias("tier"))


def vector_fallback(vectors: DataFrame, chunks: DataFrame, query_vectors: DataFrame, k: int = 10) -> DataFrame:
    """Questions for which both channels found nothing: the nearest chunks with a text, ``bm25_score`` 0."""
    some = vectors.join(chunks.where("trim(text) <> ''").select("chunk_id"), "chunk_id", "left_semi")
    found = search.vector_search(some, query_vectors, k)
    return found.select("query_id", "chunk_id", F.round("score", 4).alias("score"), F.round("score", 4).alias("vector_score"), F.lit(0.0).alias("bm25_score"), "rank")

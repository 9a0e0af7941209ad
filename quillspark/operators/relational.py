"""Joins, set operations and ordered operators of ingest and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.shared import written

from .routing import LIST_WORDS, any_word, inside


def not_indexed(files: DataFrame, indexed: DataFrame, key: str = "source") -> DataFrame:
    """Files whose key is not indexed yet."""
    return files.join(indexed.select(key).distinct(), key, "left_anti")


def first_wins(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Union in which rows of ``existing`` win."""
    return existing.unionByName(incoming.join(existing.select(key), key, "left_anti"))


def enrich(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest data by file; else the archive id or a title from the stem. ``files``: file; ``manifest``: file, archive_id, title."""
    stem = F.regexp_replace("file", r"\.pdf$", "")
    is_id = stem.rlike(r"^[0-9]{4}\.[0-9]{4,5}([vV][0-9]+)?$")
    known = F.col("m_file").isNotNull()
    joined = files.join(manifest.select(F.col("file").alias("m_file"), F.col("archive_id").alias("m_id"), F.col("title").alias("m_title")), F.col("file") == F.col("m_file"), "left")
    return joined.select(
        "file",
        F.when(known, F.col("m_id")).when(is_id, stem).otherwise("").alias("archive_id"),
        F.when(known, F.col("m_title")).when(is_id, "").otherwise(F.replace(stem, F.lit("_"), F.lit(" "))).alias("title"),
    )


def resolve(wanted: DataFrame, listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """A paper's local file by manifest, archive id, stem, then any file of the stem with a suffix.

    ``wanted``: archive_id, stem; ``listing``: file; ``manifest``: archive_id, file.
    """
    files = listing.select(F.col("file").alias("f"), F.regexp_replace("file", r"(_[^_]*)?\.pdf$", "").alias("base"))
    plain = files.select("f").distinct()
    w = wanted.join(manifest.select("archive_id", F.col("file").alias("by_manifest")), "archive_id", "left")
    for name, path in (("by_id", F.concat("archive_id", F.lit(".pdf"))), ("by_stem", F.concat("stem", F.lit(".pdf")))):
        w = w.withColumn("p", path).join(plain.withColumnRenamed("f", name), F.col("p") == F.col(name), "left").drop("p")
    suffixed = files.where(F.col("f").rlike(r"_[^_]*\.pdf$")).groupBy("base").agg(F.min("f").alias("by_suffix"))
    w = w.join(suffixed, F.col("stem") == F.col("base"), "left")
    return w.select("archive_id", "stem", F.coalesce("by_manifest", "by_id", "by_stem", "by_suffix").alias("file"))


def bundle_sections(hits: DataFrame, chunks: DataFrame, keys: list[str], list_size: int = 3) -> DataFrame:
    """Hits plus all siblings of hits in list sections (three chunks or a telling title); siblings score 0.

    ``hits``: query_id, chunk_id, score; ``chunks``: chunk_id, ``keys``, section_title, idx.
    """
    wanted = hits.join(chunks.select("chunk_id", *keys), "chunk_id").select("query_id", *keys).distinct()
    own = chunks.select("chunk_id", *keys, "section_title", "idx").join(wanted.select(*keys).distinct(), keys, "left_semi")  # sections that were hit, no others
    sized = own.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("section_title", "idx").alias("title"))
    listed = sized.where((F.col("n") >= list_size) | any_word(F.col("title"), LIST_WORDS)).select(*keys)
    siblings = own.join(wanted.join(listed, keys, "left_semi"), keys).select("query_id", "chunk_id", F.lit(0.0).alias("score"))
    return siblings.unionByName(hits.select("query_id", "chunk_id", "score")).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def page_neighbourhood(figures: DataFrame, targets: DataFrame, reach: int = 3) -> DataFrame:
    """Figures within ``reach`` pages of a target page, of its type or whole pages.

    ``figures``: id, paper, page_no, kind; ``targets``: target_id, paper, page_no, kind. The range
    becomes an equi-join on the pages it holds.
    """
    pages = targets.select("target_id", "paper", F.col("kind").alias("want"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("page_no") - reach), F.col("page_no") + reach)).alias("page_no"))
    return figures.join(pages, ["paper", "page_no"]).where((F.col("kind") == F.col("want")) | (F.col("kind") == "page"))


def keyword_source(keywords: DataFrame, sources: DataFrame) -> DataFrame:
    """``keyword, source``: the first source (by ``idx``) whose name or title holds the keyword, else the first whose archive id does.

    ``sources``: source, title, archive_id, idx, one row a source. Keywords of one character find nothing.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    words = keywords.select(F.lower("keyword").alias("token")).where("char_length(token) >= 2").distinct()
    names = sources.select("source", "idx", low("source").alias("name"), low("title").alias("title"), low("archive_id").alias("archive_id"))
    met = inside(words, names, ["name", "title", "archive_id"], 2)
    by_name = F.contains("name", "token") | F.contains("title", "token")
    first = met.groupBy("token").agg(F.min_by("source", F.struct((~by_name).alias("late"), "idx")).alias("source"))
    return keywords.join(first, F.lower("keyword") == F.col("token")).select("keyword", "source")


def backfill(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` (chunk_id, idx, text) with missing texts taken from ``texts`` (chunk_id, idx, text): by id, else by position."""
    by_id = texts.select("chunk_id", F.nullif("text", F.lit("")).alias("_by_id"))
    by_place = texts.select("idx", F.nullif("text", F.lit("")).alias("_by_place"))
    joined = rows.join(by_id, "chunk_id", "left").join(by_place, "idx", "left")
    return joined.withColumn("text", F.coalesce(F.nullif("text", F.lit("")), "_by_id", "_by_place")).drop("_by_id", "_by_place")


def search_captions(figures: DataFrame, wanted: str, source: str | None = None, limit: int = 20) -> DataFrame:
    """Figures whose caption or page text holds the words, by id. ``figures``: id, paper_source, caption, page_text."""
    pattern = "%" + wanted.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hit = figures.where(F.col("caption").ilike(pattern) | F.col("page_text").ilike(pattern))
    if source is not None:
        hit = hit.where(F.col("paper_source") == source)
    return hit.orderBy("id").limit(limit)


def figures_of_hits(hits: DataFrame, figures: DataFrame) -> DataFrame:
    """The rows of a text search (``rowid``) joined with their figures."""
    return hits.join(figures, F.col("rowid") == F.col("id")).drop("rowid")


def residue(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows that still hold a page stamp, with its number of places and what stands around the first."""
    mark = r"(?i)ar\s*Xiv:"
    found = rows.withColumn("n_stamps", F.regexp_count(text, F.lit(mark)).cast("long")).where("n_stamps > 0")
    at = F.regexp_instr(text, F.lit(mark))
    return found.withColumn("around", F.substring(text, F.greatest(at - 10, F.lit(1)), F.lit(60)))


def dedup_text(rows: DataFrame, order: list[Column], group: list[str] | None = None, text: str = "text", prefix: int = 500) -> DataFrame:
    """The first row, by ``order``, of each prefix of the text."""
    w = Window.partitionBy(*(group or []), F.substring(text, 1, prefix)).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def dedup_index(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    w = Window.partitionBy(key).orderBy(*order)
    first = rows.where(F.col(key).isNotNull()).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
    return first.unionByName(rows.where(F.col(key).isNull()))


def numbered(rows: DataFrame, order: list[str], base: int = 0) -> DataFrame:
    """Adds ``idx``: the row's place by an order, without one task sorting the whole table.

    Rows are range-partitioned, numbered within their partition and written once; the counts by partition and
    the numbers come from that one copy, so both see the same partitions. Ties of the
    order fall by the hash of the whole row, so a hot value is spread over partitions too.
    """
    tie = F.xxhash64(*rows.columns)
    ranged = rows.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    ranged = written(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "ranged")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))  # one row a partition
    return ranged.join(F.broadcast(before.select("_p", "_before", "_first")), "_p").withColumn("idx", (F.col("_i") - F.col("_first") + F.col("_before") + base).cast("long")).drop("_p", "_i", "_first", "_before")


def stem_matches(questions: DataFrame, sources: DataFrame, least: int = 3) -> DataFrame:
    """``query_id, source``: the source most of whose stem's longer words stand in the question, if ``least`` do.

    Words join by equality; only pairs with a common word arise.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.char_length(t) > 3))
    q = questions.select("query_id", F.explode(words(F.col("text"))).alias("word"))
    s = sources.select("source", F.explode(words(F.regexp_replace("source", r"\.pdf$", ""))).alias("word"))
    hits = q.join(s, "word").groupBy("query_id", "source").agg(F.count("*").alias("hits")).where(F.col("hits") >= least)
    w = Window.partitionBy("query_id").orderBy(F.col("hits").desc(), "source")
    return hits.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")

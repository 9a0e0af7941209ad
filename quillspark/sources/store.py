"""The stored index: chunks by source, vectors, term statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import embed_text, slug
from quillspark.operators.chunking import chunk_papers
from quillspark.operators.relational import numbered
from quillspark.operators.search import Bm25Index, bm25_index
from quillspark.shared import discard, written


class IndexStore:
    """Parquet folders under one root. Chunks lie in ``buckets`` folders by the hash of their paper, so one paper is one pruned read and
    millions of papers are no millions of folders."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _bucket(self, source: Column) -> Column:
        return F.pmod(F.xxhash64(slug(source)), F.lit(self.buckets)).cast("int")

    def append(self, chunks: DataFrame) -> None:
        """Add chunks (``source, chunk_id, text`` and more) of papers that are not stored yet."""
        placed = chunks.withColumns({"paper": slug(F.col("source")), "bucket": self._bucket(F.col("source"))})
        placed.repartition("bucket", "paper").write.mode("append").partitionBy("bucket").parquet(f"{self.root}/chunks")

    def remove(self, source: str) -> None:
        """Take a paper out: its bucket is written anew without it."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(source))).first()[0]
        rest = written(self._read("chunks").where((F.col("bucket") == bucket) & (F.col("source") != source)), "bucket")
        where = f"{self.root}/chunks/bucket={bucket}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        rest.drop("bucket").write.mode("overwrite").parquet(where)
        discard(rest)

    def has(self, source: str) -> bool:
        return not self.chunks(source).isEmpty()

    def append_vectors(self, vectors: DataFrame) -> None:
        vectors.write.mode("append").parquet(f"{self.root}/vectors")

    def chunks(self, source: str | None = None) -> DataFrame:
        """All chunks, or those of one paper (a pruned partition)."""
        rows = self._read("chunks")
        if source is not None:
            bucket = self.spark.range(1).select(self._bucket(F.lit(source))).first()[0]
            rows = rows.where((F.col("bucket") == bucket) & (F.col("paper") == slug(F.lit(source))))
        return rows.drop("bucket")

    def sources(self) -> DataFrame:
        """``source, n``: stored papers and their numbers of chunks."""
        return self._read("chunks").groupBy("source").agg(F.count("*").alias("n"))

    def vectors(self) -> DataFrame:
        """Vectors; each must have its chunk, and each chunk its vector."""
        rows, chunks = self._read("vectors"), self._read("chunks")
        if not rows.join(chunks, "chunk_id", "left_anti").isEmpty():
            raise ValueError("a vector has no chunk")
        if not chunks.join(rows, "chunk_id", "left_anti").isEmpty():
            raise ValueError("a chunk has no vector")
        return rows

    def save_bm25(self) -> None:
        """Recompute the statistics over all chunks: appending changes every idf."""
        index = bm25_index(self._read("chunks").drop("paper", "bucket"))
        index.idf.write.mode("overwrite").parquet(f"{self.root}/idf")
        index.stats.write.mode("overwrite").parquet(f"{self.root}/stats")
        index.chunks.write.mode("overwrite").parquet(f"{self.root}/tokens")

    def bm25(self) -> Bm25Index:
        return Bm25Index(self._read("tokens"), self._read("idf"), self._read("stats"))

    def ensure(self, n_files: int) -> tuple[bool, str]:
        """Whether a search can start: an index stands, or there are files to build one from."""
        try:
            n = self._read("chunks").count()
        except Exception:  # no table yet
            n = 0
        if n:
            return True, f"{n} chunks stored"
        return (True, "files present, an index will be built") if n_files else (False, "no files and no index")

    def build(self, papers: DataFrame, embed: Callable[[Column], Column], rebuild: bool = False) -> int:
        """Chunk, number, embed and store the papers (``source, title, full_text``, ``archive_id``, ``abstract``) that are not stored yet; the number of new chunks.

        An abstract is a paper's first chunk. Numbers go on from the greatest stored one; the statistics are computed anew.
        """
        if not rebuild and self.ensure(0)[0]:
            papers = papers.join(self.sources(), "source", "left_anti")
            base = self._read("chunks").agg(F.max("chunk_id")).first()[0] + 1
        else:
            base = 0
        body = chunk_papers(papers).withColumn("start", F.coalesce("start", F.lit(0)))
        first = papers.where("trim(abstract) <> ''").select("source", F.lit(-1).alias("start"), F.lit(0).cast("long").alias("ordinal"), F.col("abstract").alias("text"), F.lit("abstract").alias("chunk_type"), F.lit("Abstract").alias("section_title"))
        rows = body.unionByName(first, allowMissingColumns=True).join(papers.select("source", "title", "archive_id"), "source")
        chunks = written(numbered(rows, ["source", "start", "ordinal"], base).withColumnRenamed("idx", "chunk_id"), "chunks")
        before = F.lag("text").over(Window.partitionBy("source").orderBy("chunk_id"))
        told = chunks.withColumn("embed_text", embed_text(F.col("title"), F.col("section_title"), before, F.col("text")))
        mode = "overwrite" if rebuild else "append"
        if rebuild:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/chunks")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.append(chunks)
        told.select("chunk_id", embed(F.col("embed_text")).alias("embedding")).write.mode(mode).parquet(f"{self.root}/vectors")
        self.save_bm25()
        n = chunks.count()
        discard(chunks)
        return n


def old_bm25(payload: DataFrame) -> DataFrame:
    """``chunk_id, text`` of an old payload (one row: ``corpus``, an array of texts): its ids are places."""
    return payload.select(F.posexplode("corpus").alias("chunk_id", "text")).withColumn("chunk_id", F.col("chunk_id").cast("long"))


def save_manifest(entries: DataFrame, path: str) -> None:
    """``file, archive_id, title`` as JSON lines; a file's last entry wins on reading."""
    entries.select("file", "archive_id", "title").write.mode("append").json(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of ``save_manifest``; without a readable file none."""
    schema = "file string, archive_id string, title string"
    try:
        rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception:  # no such folder
        return spark.createDataFrame([], schema)
    return rows.where("file is not null").dropDuplicates(["file"])


def save_results(results: DataFrame, path: str) -> None:
    """Results or metrics as JSON lines, one row a line."""
    results.write.mode("overwrite").json(path)


def download(papers: DataFrame, fetch: Callable[[str], bytes], path: str, most: int | None = None, force: bool = False) -> DataFrame:
    """Fetch files that are not stored yet (all with ``force``) into a table ``file, content`` at ``path``; returns it.

    ``papers``: file, pdf_url. A file that can't be fetched is left out and tried again the next time.
    """
    spark = papers.sparkSession
    wanted = papers.select("file", "pdf_url").dropDuplicates(["file"])
    try:
        stored = spark.read.parquet(path)
    except Exception:  # nothing stored yet
        stored = None
    if stored is not None and not force:
        wanted = wanted.join(stored.select("file"), "file", "left_anti")
    if most is not None:
        wanted = wanted.orderBy("file").limit(most)

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for file, url in zip(batch["file"], batch["pdf_url"]):
                try:
                    out.append((file, fetch(url)))
                except Exception:  # any failure of the network
                    continue
            yield pd.DataFrame(out, columns=["file", "content"])

    new = written(wanted.mapInPandas(run, "file string, content binary"), "fetched")
    kept = new if stored is None else written(stored.join(new.select("file"), "file", "left_anti").unionByName(new), "files")
    kept.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

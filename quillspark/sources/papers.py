"""Paper metadata as a Spark data source, local listings and manifests.

The search service itself is outside the engine: the source reads metadata from JSON lines that
any client may have fetched, and applies the service's clauses (terms, dates, categories,
sort) as DataFrame operations, so Spark can push what it can.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.functions.text import in_date_range

PAPER = "archive_id string, title string, abstract string, authors array<string>, categories array<string>, published string, updated string, pdf_url string"


class PaperSource(DataSource):
    """``spark.read.format("papers").option("lines", ...)``: metadata given as JSON lines in an option, in parts of ``part`` lines.

    Files of lines are read by ``read_papers``, with Spark's own reader.
    """

    @classmethod
    def name(cls) -> str:
        return "papers"

    def schema(self) -> str:
        return PAPER

    def reader(self, schema) -> DataSourceReader:
        return PaperReader(self.options, [f.name for f in schema.fields])


class PaperReader(DataSourceReader):
    def __init__(self, options, names: list[str]):
        self.lines, self.part, self.names = options.get("lines", "").splitlines(), int(options.get("part", "1000")), names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(at) for at in range(0, max(len(self.lines), 1), self.part)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for line in self.lines[partition.value : partition.value + self.part]:
            if line.strip():
                row = json.loads(line)
                yield tuple(row.get(n) for n in self.names)


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Metadata from JSON lines at any path that Spark reads; broken lines go."""
    return spark.read.schema(PAPER).option("mode", "DROPMALFORMED").json(path)


def search_or_retry(papers: DataFrame, terms: str, rewritten: str | None = None, **how) -> DataFrame:
    """Search by the rewritten terms, and by the question's own over all fields if they find nothing."""
    found = search(papers, rewritten or terms, **how)
    if rewritten and rewritten != terms and found.isEmpty():
        return search(papers, terms, **how)
    return found


def search(papers: DataFrame, terms: str, date_from: str | None = None, date_to: str | None = None, field: str = "submitted", categories: list[str] | None = None, sort: str = "relevance", descending: bool = True, limit: int = 20) -> DataFrame:
    """Papers that have every term in title or abstract; dates and categories as filters.

    ``relevance`` orders by the number of term occurrences.
    """
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    words = [w for w in terms.lower().split() if w]
    hit: Column = F.lit(True)
    score: Column = F.lit(0)
    for w in words:
        hit = hit & F.contains(text, F.lit(w))
        score = score + F.floor((F.char_length(text) - F.char_length(F.replace(text, F.lit(w), F.lit("")))) / len(w))
    stamp = F.col("updated" if field == "updated" else "published")
    found = papers.where(hit & in_date_range(stamp, date_from, date_to))
    if categories:
        found = found.where(F.arrays_overlap("categories", F.array(*map(F.lit, categories))))
    by = {"relevance": score if words else None, "submittedDate": F.col("published"), "lastUpdatedDate": F.col("updated")}[sort]
    order = [] if by is None else [by.desc() if descending else by.asc()]
    return found.orderBy(*order, "archive_id").limit(limit)


def year(papers: DataFrame) -> DataFrame:
    """Adds ``year`` (0 without a date) and ``first_author`` (``Unknown`` without one)."""
    return papers.withColumn("year", F.coalesce(F.expr("try_cast(substring(published, 1, 4) as int)"), F.lit(0))).withColumn("first_author", F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit("Unknown")))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """``file``: names of the folder's PDF files, sorted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file")).orderBy("file")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file, archive_id, title``: a manifest's entries; a broken file is an empty manifest."""
    text = spark.read.text(path, wholetext=True)
    kind = "struct<files:map<string,struct<arxiv_id:string,title:string>>>"
    files = text.select(F.explode(F.from_json("value", kind)["files"]).alias("file", "entry"))
    return files.select("file", F.col("entry.arxiv_id").alias("archive_id"), F.col("entry.title").alias("title"))

"""Orchestration: rewrite, search, index, retrieve, answer. Models are plugs; offline ones are deterministic."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import tokenize
from quillspark.functions.vectors import hashed_embedding
from quillspark.operators import dialogue, quality_of_search, relational, rewriting, search
from quillspark.sources import parsing


def quote_answer(question: str, context: str) -> str:
    """The offline generator: the first lines of the context."""
    return context[:500] if context else "no source found"


#: Engines by kind and name: parser, embedder, reranker, rewriter, generator.
PLUGS: dict[str, dict[str, Callable]] = {
    "parser": dict(parsing.ENGINES),
    "embedder": {"hashed": lambda text: hashed_embedding(tokenize(text))},
    "reranker": {"overlap": quality_of_search.overlap_ranker},
    "rewriter": {"templates": rewriting.template_generator},
    "generator": {"quote": quote_answer},
}


def register(kind: str, name: str, plug: Callable) -> None:
    """Add an engine; one of the same name is replaced."""
    if kind not in PLUGS:
        raise ValueError(f"no kind {kind!r} among {sorted(PLUGS)}")
    PLUGS[kind][name] = plug


def plug(kind: str, name: str) -> Callable:
    if name not in PLUGS.get(kind, {}):
        raise ValueError(f"no {kind} {name!r} among {sorted(PLUGS.get(kind, {}))}")
    return PLUGS[kind][name]


def context_line(rank: Column, chunks: DataFrame, limit: int = 1500) -> Column:
    """A source as the model sees it: its place, file and section, a table marked as one."""
    has = lambda c: F.col(c) if c in chunks.columns else F.lit("")
    named = F.when(F.coalesce(has("table_id").cast("string"), F.lit("")) != "", F.concat(F.lit(" table "), has("table_id"))).otherwise("")
    section = F.when(F.coalesce(has("section_title").cast("string"), F.lit("")) != "", F.concat(F.lit(", "), has("section_title"))).otherwise("")
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), F.coalesce(has("source").cast("string"), F.lit("")), section, named, F.lit("\n"), F.substring("text", 1, limit))


def figures_near(answer_source: DataFrame, cited: DataFrame, figures: DataFrame, reach: int = 3) -> DataFrame:
    """Figures of an answer: those within ``reach`` pages of a cited one. ``answer_source``: query_id, source; ``cited``: query_id, page_no, kind."""
    targets = cited.join(answer_source, "query_id").select(F.col("query_id").alias("target_id"), F.col("source").alias("paper"), "page_no", "kind")
    return relational.page_neighbourhood(figures, targets, reach)


@dataclass
class Assistant:
    """Answers questions over an index; ``steps`` records what was done and how it went."""

    index: search.Bm25Index
    generate: Callable[[str, str], str] = quote_answer
    top_k: int = 5
    rewrite: Callable | None = None
    papers: DataFrame | None = None  # the metadata whose abstracts stand in where nothing is found
    steps: list[tuple[str, str]] = field(default_factory=list)

    def _step(self, name: str, action: Callable):
        try:
            out = action()
            self.steps.append((name, "done"))
            return out
        except Exception as e:  # a step that fails is reported, and the next ones go on without it
            self.steps.append((name, f"failed: {e}"))
            return None

    def _asked(self, question: str) -> DataFrame:
        return self.index.chunks.sparkSession.createDataFrame([(0, question)], "query_id long, text string")

    def retrieve(self, question: str) -> DataFrame:
        """The best chunks by the question, its rewrites and its expansions."""
        asked = self._asked(question)
        more = asked.select("query_id", F.explode(F.concat(F.array("text"), dialogue.expansions(F.col("text")))).alias("text"))
        if self.rewrite is not None:
            more = more.unionByName(rewriting.rewrites(asked, self.rewrite).where("place > 0").select("query_id", "text"))
        numbered = more.select(F.monotonically_increasing_id().alias("query_id"), "text")
        found = search.bm25_search(self.index, numbered.distinct(), self.top_k)
        best = found.groupBy("chunk_id").agg(F.max("score").alias("score")).withColumn("query_id", F.lit(0).cast("long"))
        return search.top_k(best, self.top_k)

    def context(self, question: str) -> str:
        best = self.retrieve(question).select("chunk_id", "rank").join(self.index.chunks, "chunk_id").orderBy("rank")
        return "\n\n".join(r[0] for r in best.select(context_line(F.col("rank"), self.index.chunks)).collect())  # top_k rows

    def abstracts(self, question: str) -> str:
        """Titles and abstracts of papers on the question, where there is no chunk."""
        from quillspark.sources.papers import search as search_papers

        if self.papers is None:
            return ""
        words = [w for w in question.lower().split() if len(w) > 3]
        for n in range(len(words), 0, -1):  # fewer and fewer words until some paper has them all
            rows = search_papers(self.papers, " ".join(words[:n]), limit=self.top_k).select("title", "abstract").collect()  # top_k rows
            if rows:
                return "\n\n".join(f"{r[0]}\n{r[1]}" for r in rows)
        return ""

    def ask(self, question: str) -> str:
        """Retrieve ``top_k`` chunks (abstracts if there are none), assemble a context, generate."""
        found = self._step("retrieve", lambda: self.context(question)) or self._step("abstracts", lambda: self.abstracts(question)) or ""
        return self._step("generate", lambda: self.generate(question, found)) or ""

    def quick(self, question: str, messages: list[tuple[str, str]], most: int = 10) -> str:
        """Answer within a conversation: the last ``most`` messages (role, text) stand before the sources."""
        told = "\n".join(f"{role}: {text[:300]}" for role, text in messages[-most:])
        found = self._step("retrieve", lambda: self.context(question)) or ""
        return self._step("generate", lambda: self.generate(question, "\n\n".join(x for x in (found, told) if x))) or ""

    def report(self) -> DataFrame:
        """``nth, step, status`` of what was done."""
        rows = [(i, *s) for i, s in enumerate(self.steps)]
        return self.index.chunks.sparkSession.createDataFrame(rows, "nth int, step string, status string")


def tools(assistant: Assistant, papers: DataFrame) -> dict[str, Callable[..., str]]:
    """The tool registry: each returns JSON, errors too."""
    from quillspark.sources.papers import listing
    from quillspark.sources.papers import search as search_papers

    def safe(f: Callable) -> Callable[..., str]:
        def call(*args, **named) -> str:
            try:
                return json.dumps(f(*args, **named), ensure_ascii=False)
            except Exception as e:
                return json.dumps({"error": str(e)})

        return call

    def listed(df: DataFrame) -> list[dict]:
        shown = df.select("archive_id", "title", F.slice("authors", 1, 3).alias("authors"), F.substring("abstract", 1, 300).alias("abstract"), F.slice("categories", 1, 3).alias("categories"))
        return [r.asDict() for r in shown.collect()]  # at most the search's limit

    return {
        "search_papers": safe(lambda terms, **how: listed(search_papers(papers, terms, **how))),
        "get_paper_info": safe(lambda archive_id: (listed(papers.where(F.col("archive_id") == archive_id).limit(1)) or [None])[0]),
        "rag_query": safe(lambda question: [{"chunk_id": r["chunk_id"], "score": round(r["score"], 4)} for r in assistant.retrieve(question).orderBy("rank").collect()]),
        "ask": safe(assistant.ask),
        "rewrite_query": safe(lambda question: [r["text"] for r in rewriting.rewrites(assistant._asked(question)).orderBy("place").collect()]),
        "list_local_papers": safe(lambda folder: [r["file"] for r in listing(papers.sparkSession, folder).collect()]),
    }

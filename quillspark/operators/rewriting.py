"""Rewriting by plugs: a generator takes a batch of prompts and gives a text for each; the offline one is built of templates.

Every way of rewriting ends in the same filter: distinct texts in order, the original first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dialogue import distinct_rewrites, history, strategy

#: kind, texts -> for each text its rewrites.
Generator = Callable[[str, list[str]], list[list[str]]]
KINDS = ("academic", "hypothetical", "multi", "keywords", "chinese_academic", "contextual", "step_back")
_FILLER = {"what", "which", "how", "why", "does", "do", "is", "are", "the", "a", "an", "of", "in", "on", "for", "to", "and", "please", "show", "me", "about"}


def template_generator(kind: str, texts: list[str]) -> list[list[str]]:
    """The offline stand-in: deterministic and without a model."""

    def made(text: str) -> list[str]:
        words = [w for w in text.replace("?", " ").split() if w.lower() not in _FILLER]
        core = " ".join(words)
        if not words:
            return []
        if kind == "hypothetical":
            return [f"This paper presents {core} and reports its results."]
        if kind == "multi":
            return [f"{core} method", f"{core} experiments and results", f"{core} related work"]
        if kind == "keywords":
            return [" ".join(dict.fromkeys(w.lower() for w in words))]
        if kind == "step_back":
            return [f"background of {' '.join(words[:4])}"]
        if kind == "contextual":
            return [text]
        return [f"{core} approach and evaluation"]

    return [made(t) for t in texts]


def generated(rows: DataFrame, kind: str, generate: Generator) -> DataFrame:
    """``rows`` with ``made``, the generator's texts for ``prompt``; a generator that fails or answers short gives none."""

    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in prompts:
            texts = batch.fillna("").tolist()
            try:
                found = [list(x) for x in generate(kind, texts)]
            except Exception:  # a plug may fail in any way: the original stands then
                found = []
            yield pd.Series(found if len(found) == len(texts) else [[] for _ in texts])

    return rows.withColumn("made", F.pandas_udf(run, "array<string>")(F.col("prompt")))


def rewrites(questions: DataFrame, generate: Generator = template_generator, kind: str | None = None, limit: int = 6) -> DataFrame:
    """``query_id, place, text``: the question (place 0) and its distinct rewrites; without ``kind`` by the question's own strategy."""
    planned = questions.select("query_id", "text", (F.lit(kind) if kind else strategy(F.col("text"))).alias("kind"))
    every = planned.select("query_id", F.lit(0).alias("pos"), "text")
    for one in [kind] if kind else ["academic", "multi", "chinese_academic"]:
        made = generated(planned.where(F.col("kind") == one).withColumn("prompt", F.col("text")), one, generate)
        every = every.unionByName(made.select("query_id", F.posexplode("made").alias("pos", "text")).withColumn("pos", F.col("pos") + 1))
    return distinct_rewrites(every, limit)


def for_search_service(found: DataFrame) -> DataFrame:
    """``query_id, text``: the first text of ``rewrites`` without CJK letters, else the original."""
    cjk = F.col("text").rlike("[一-鿿]")
    return found.groupBy("query_id").agg(F.coalesce(F.min_by(F.when(~cjk, F.col("text")), F.when(~cjk, F.col("place"))), F.min_by("text", "place")).alias("text"))


def contextual(messages: DataFrame, generate: Generator = template_generator, least: int = 2) -> DataFrame:
    """``conv_id, turn, text``: user questions made to stand alone by the six messages before them; with fewer than ``least`` they stay.

    ``messages``: conv_id, turn, role, text. The generator sees the history and the question.
    """
    told = history(messages).withColumn("n", F.size(F.filter(F.split("history", "\n"), lambda x: x != ""))).where("role = 'user'")
    asked = told.withColumn("prompt", F.when(F.col("n") >= least, F.concat("history", F.lit("\n\n"), "text")))
    made = generated(asked, "contextual", lambda kind, texts, own=generate: own(kind, texts))
    if generate is template_generator:
        return made.select("conv_id", "turn", "text")
    return made.select("conv_id", "turn", F.when((F.col("n") >= least) & (F.size("made") > 0), F.get("made", F.lit(0))).otherwise(F.col("text")).alias("text"))


def step_back(questions: DataFrame, generate: Generator = template_generator) -> DataFrame:
    """``query_id, text``: a wider question for each; none where the generator gives none."""
    made = generated(questions.withColumn("prompt", F.col("text")), "step_back", generate)
    return made.where(F.size("made") > 0).select("query_id", F.get("made", F.lit(0)).alias("text"))

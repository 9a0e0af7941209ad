"""Query expansion, history and entity memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import has_cjk

from .routing import INTENTS, any_word

#: What is put before a question, by intent.
EXPANSIONS = {
    "dataset": ["Datasets and Benchmarks and Evaluation ", "Experimental Settings and Datasets "],
    "experiment": ["Experiments and Results ", "Ablation Study and Comparison "],
    "config": ["Implementation Details and Parameters ", "Experimental Settings and Configuration "],
}
#: Entity patterns of the conversation memory and how many of each are kept.
ENTITIES = {
    "paper": ('(?i)(?:论文|paper|work|method)\\s*[：:]\\s*["“”]?([^"“”\\n]{5,60})["“”]?', 1, 10),
    "method": (r"([A-Z][A-Za-z0-9/-]*(?:Net|Former|Model|GNN|CNN|RNN|GAN|VAE|SAM|DETR|YOLO|BERT|GPT|LoRA|Caps))", 1, 10),
    "metric": ("(?i)([0-9]+\\.?[0-9]*\\s*%?\\s*(?:准确率|精度|召回率|F1|sensitivity|specificity|accuracy|precision|recall|mIoU|AUC|NDCG|MRR))", 1, 10),
    "table": (r"(?i)Table[_\s]([0-9]+)", 1, 5),
}


def strategy(question: Column) -> Column:
    """How a question is rewritten: by script, then by length."""
    return F.when(has_cjk(question), "chinese_academic").when(F.char_length(question) > 100, "multi").otherwise("academic")


def expansions(question: Column, limit: int = 4) -> Column:
    """At most ``limit`` questions with the section words of their intents before them."""
    none = F.array().cast("array<string>")
    parts = [F.when(any_word(question, INTENTS[name]), F.array(*[F.concat(F.lit(p), question) for p in prefixes])).otherwise(none) for name, prefixes in EXPANSIONS.items()]
    return F.slice(F.concat(*parts), 1, limit)


def distinct_rewrites(rewrites: DataFrame, limit: int = 6, least_words: int = 3) -> DataFrame:
    """``query_id, place, text``: distinct rewrites, in order, ignoring case; short ones go, but for the original (place 0).

    ``rewrites``: query_id, pos, text.
    """
    text = F.trim("text")
    long_enough = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= least_words
    good = rewrites.withColumn("text", text).where((F.col("pos") == 0) | long_enough)
    same = Window.partitionBy("query_id", F.lower("text")).orderBy("pos")
    order = Window.partitionBy("query_id").orderBy("pos")
    first = good.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    return first.withColumn("place", (F.row_number().over(order) - 1).cast("long")).where(F.col("place") < limit).select("query_id", "place", "text")


def history(messages: DataFrame, size: int = 6, chars: int = 300) -> DataFrame:
    """Each message with the ``size`` before it, cut to ``chars``, as one text. ``messages``: conv_id, turn, role, text."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-size, -1)
    line = F.concat("role", F.lit(": "), F.substring("text", 1, chars))
    return messages.withColumn("history", F.array_join(F.collect_list(line).over(w), "\n"))


def entities(messages: DataFrame) -> DataFrame:
    """``conv_id, kind, entity, first_seen``: entities of each conversation, the last ones of each kind by first mention."""
    def mentions(kind: str) -> Column:
        pattern, group, limit = ENTITIES[kind]
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(limit).alias("most"), i.alias("at"), x.alias("entity")))

    found = messages.select("conv_id", "turn", F.explode(F.concat(*map(mentions, ENTITIES))).alias("m")).select("conv_id", "turn", "m.*")  # one scan for all kinds
    named = F.when(F.col("kind") == "table", F.concat(F.lit("Table_"), "entity")).otherwise(F.trim("entity"))
    first = found.withColumn("entity", named).where("entity <> ''").groupBy("conv_id", "kind", "entity", "most").agg(F.min(F.struct("turn", "at")).alias("seen"))
    newest = Window.partitionBy("conv_id", "kind").orderBy(F.col("seen").desc())
    return first.withColumn("_n", F.row_number().over(newest)).where("_n <= most").select("conv_id", "kind", "entity", F.col("seen.turn").alias("first_seen"))


#: The headings of the memory's prompt and how many of each kind it names; words that point back, and which of them are replaced.
PROMPT = {"paper": ("之前提到的论文", 5), "method": ("讨论过的方法", 5), "metric": ("提及的指标", 5), "table": ("引用过的表格", 3)}
POINTERS = {"method": (["这个方法", "该模型", "那个方法", "上一个", "上述"], ["这个方法", "该模型"]), "table": (["这张表", "该表", "上表", "表格"], ["这张表", "该表"]), "paper": (["该论文", "这篇文章", "这篇论文"], ["该论文"])}


def memory(entity_rows: DataFrame) -> DataFrame:
    """``conv_id`` and an array for each kind of entity, in the order of first mention. ``entity_rows``: as ``entities`` gives them; bounded by their limits."""
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("first_seen", "entity")))), lambda x: x["entity"]).alias(kind)
    return entity_rows.groupBy("conv_id").agg(*map(listed, ENTITIES))


def context_prompt(topic: Column | None = None) -> Column:
    """What a conversation's ``memory`` tells a model, over its array columns."""
    last = lambda kind, n: F.slice(F.col(kind), F.greatest(F.size(kind) - n + 1, F.lit(1)), n)
    parts = [F.when(F.size(kind) > 0, F.concat(F.lit(f"{title}: "), F.array_join(last(kind, n), "、"))) for kind, (title, n) in PROMPT.items()]
    if topic is not None:
        parts.append(F.when(F.coalesce(topic, F.lit("")) != "", F.concat(F.lit("上轮话题: "), topic)))
    return F.concat_ws(" | ", *parts)


def resolved(question: Column) -> Column:
    """The question with words that point back replaced by the last method, table or paper of its ``memory`` columns; the first kind that is pointed at and known counts."""
    out = question
    for kind, (pointing, replaced) in reversed(POINTERS.items()):
        new = question
        for word in replaced:
            new = F.replace(new, F.lit(word), F.element_at(kind, -1))
        out = F.when(F.lower(question).rlike("|".join(pointing)) & (F.size(kind) > 0), new).otherwise(out)
    return out

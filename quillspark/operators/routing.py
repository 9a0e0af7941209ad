"""What a question asks for: intent, references, the paper it names, and the degradation tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import match_text

#: Words that show an intent, tested in this order, as substrings of the lower-case question.
INTENTS = {
    "architecture": ["骨干", "backbone", "架构", "encoder", "decoder", "网络结构", "architecture", "module", "block", "head", "neck", "编码器", "解码器", "resnet", "vgg", "efficientnet", "transformer", "vit", "层次", "layer", "组件"],
    "dataset": ["数据集", "数据", "训练集", "测试集", "datasets", "data", "benchmarks", "benchmark", "evaluation", "kvasir", "cvc", "polyp"],
    "experiment": ["实验", "对比", "结果", "performance", "results", "experiment", "ablation", "comparison"],
    "config": ["参数", "配置", "setting", "implementation", "parameter", "hyperparameter", "setup"],
}
#: Words in the titles of sections that answer an intent.
SECTION_WORDS = {
    "architecture": ["method", "model", "architecture", "network", "encoder", "decoder", "design", "approach", "framework", "implementation", "proposed", "pipeline", "ablation", "component"],
    "dataset": ["dataset", "data", "benchmark", "evaluation", "experimental", "setup", "material", "kvasir", "cvc", "colon"],
    "experiment": ["experiment", "result", "ablation", "comparison", "evaluation", "performance", "analysis", "discussion"],
    "config": ["implementation", "parameter", "setting", "setup", "configuration", "detail", "training", "loss"],
}
#: Words that name no paper.
STOP_WORDS = ["the", "a", "an", "in", "on", "of", "for", "to", "and", "or", "is", "are", "what", "how", "which", "paper", "section", "chapter", "about", "using", "with", "from", "this", "that", "does", "do", "can", "请", "介绍", "分析", "总结", "对比", "方法", "模型", "论文", "章节", "部分", "哪些", "什么", "目前", "主流", "有", "是", "的", "了", "吗", "呢"]
#: Section names that a question may carry, by priority.
SECTION_NAMES = ["abstract", "introduction", "related work", "background", "method", "experiment", "result", "discussion", "conclusion"]
#: Titles whose sections are lists.
LIST_WORDS = ["dataset", "experiment", "benchmark", "data", "evaluation", "implementation", "paramet", "ablation", "result"]
#: How a question names a paper (by archive id, by a name before "paper", quoted after the Chinese word), a section
#: (Chinese, English, a number at the start) and a table.
ARCHIVE_ID = r"\b([0-9]{4}\.[0-9]{4,5}v?[0-9]*)\b"
NAMED_PAPER = "(?:the\\s+)?([A-Z][A-Za-z0-9-]+)\\s+(?:paper|论文|model)"
QUOTED_PAPER = "(?:论文|论[文著])\\s*[\"']?([^\"']{2,30}?)[\"']?\\s*(?:的|中|里|第)"
CHINESE_SECTION = "(?:第\\s*)?([0-9]+(?:\\.[0-9]+)*)\\s*[节章]"
ENGLISH_SECTION = r"(?:Section|section|CHAPTER|Chapter)\s+([0-9]+(?:\.[0-9]+)*)"
LEADING_SECTION = r"^([0-9]+(?:\.[0-9]+)*)\s"
TABLE_NUMBER = "(?:(?:[Tt]able|[Tt]ab)\\b|表)\\s*[-_.]?\\s*([0-9]+)"
#: Fixed values of the router.
EXACT, PARTIAL, SEVERAL, LEAST, MARGIN = 2.0, 1.2, 1.15, 2.8, 1.2


def any_word(text: Column, words: list[str]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False))


def intent(question: Column) -> Column:
    found = F.lit("general")
    for name in reversed(INTENTS):
        found = F.when(any_word(question, INTENTS[name]), name).otherwise(found)
    return found


def section_boost(question: Column, intent_col: Column, title: Column) -> Column:
    """1.8 (1.3 for architecture) where the title has a word of the intent; for a general question 1.3 where it has a word of the question."""
    boost = F.lit(1.0)
    for name, words in SECTION_WORDS.items():
        boost = F.when((intent_col == name) & any_word(title, words), 1.3 if name == "architecture" else 1.8).otherwise(boost)
    asked = F.filter(F.split(F.lower(question), r"\s+"), lambda w: w != "")
    return F.when((intent_col == "general") & F.exists(asked, lambda w: F.contains(F.lower(title), w)), 1.3).otherwise(boost)


def references(question: Column) -> dict[str, Column]:
    """``paper_ref``, ``section_ref``, ``table_ref``: what the question points at, else null."""
    none = lambda c: F.nullif(c, F.lit(""))
    first = lambda pattern: none(F.trim(F.regexp_extract(question, pattern, 1)))
    archive, named, quoted = first(ARCHIVE_ID), first(NAMED_PAPER), first(QUOTED_PAPER)
    named, quoted = F.when(F.char_length(named) >= 3, named), F.when(F.char_length(quoted) >= 2, quoted)
    cjk_number, number, leading = first(CHINESE_SECTION), first(ENGLISH_SECTION), first(LEADING_SECTION)
    word = F.lit(None).cast("string")
    for name in reversed(SECTION_NAMES):
        word = F.when(F.contains(F.lower(question), F.lit(name)), F.initcap(F.lit(name))).otherwise(word)
    table = first(TABLE_NUMBER)
    return {
        "paper_ref": F.coalesce(archive, quoted, named),
        "section_ref": F.coalesce(cjk_number, number, leading, word),
        "table_ref": F.when(table.isNotNull(), F.concat(F.lit("Table_"), table)),
    }


def file_tokens(source: Column) -> Column:
    """Distinct words of a file's stem and their pairs."""
    parts = F.filter(F.split(F.lower(F.regexp_replace(source, r"\.[A-Za-z0-9]+$", "")), "_"), lambda p: p != "")
    single = F.filter(parts, lambda p: (F.char_length(p) >= 2) | p.rlike("^[0-9]+$"))
    pairs = F.transform(_neighbours(parts), lambda x: F.when(F.char_length(x["a"]) >= 2, F.concat(x["a"], F.lit("_"), x["b"])))
    sam = F.when(F.exists(_neighbours(parts), lambda x: (x["a"] == "sam") & (x["b"] == "2")), F.array(F.lit("sam_2"), F.lit("sam2"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(single, F.filter(pairs, lambda p: p.isNotNull()), sam))


def question_tokens(question: Column) -> Column:
    """Distinct words of a question without stop words, their pairs, and word-number compounds."""
    parts = F.filter(F.split(F.replace(match_text(question), F.lit("_"), F.lit(" ")), r"\s+"), lambda p: p != "")
    stop = F.array(*map(F.lit, STOP_WORDS))
    good = lambda p: (F.char_length(p) >= 2) & ~F.array_contains(stop, p)
    single = F.filter(parts, good)
    near = F.filter(_neighbours(parts), lambda x: good(x["a"]))
    pairs = F.transform(near, lambda x: F.concat(x["a"], F.lit("_"), x["b"]))
    compounds = F.transform(F.filter(near, lambda x: x["b"].rlike("^[0-9]+$")), lambda x: F.concat(x["a"], x["b"]))
    return F.array_distinct(F.concat(single, pairs, compounds))


def _neighbours(parts: Column) -> Column:
    after = F.slice(parts, 2, 1 << 30)
    both = F.arrays_zip(parts.alias("a"), after.alias("b"))
    named = F.transform(both, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    return F.filter(named, lambda x: x["b"].isNotNull())


def _grams(text: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def inside(words: DataFrame, names: DataFrame, columns: list[str], n: int = 3) -> DataFrame:
    """Pairs of ``words`` (token, of ``n`` characters or more) and rows of ``names`` (source) one of whose ``columns`` holds the token.

    Whatever holds a token has all its grams of ``n`` characters: tokens meet the names that have their rarest one, and the substring test decides.
    """
    every = F.array_distinct(F.flatten(F.array(*[F.coalesce(_grams(F.col(c), n), F.array().cast("array<string>")) for c in columns])))
    grams = names.select("source", F.explode(every).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    own = words.select("token", F.explode(_grams(F.col("token"), n)).alias("gram")).join(counts, "gram", "left")
    rarest = own.groupBy("token").agg(F.min_by("gram", "n").alias("gram"), F.count_if(F.col("n").isNull()).alias("unknown")).where("unknown = 0").drop("unknown")
    met = rarest.join(grams, "gram").join(names, "source")
    holds = F.lit(False)
    for c in columns:
        holds = holds | F.coalesce(F.contains(F.col(c), F.col("token")), F.lit(False))
    return met.where(holds).drop("gram").join(words, "token")


def filename_router(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """``query_id, source, score`` of the one source a question names, if it is clear. ``sources``: distinct ``source``.

    Exact tokens join by equality; tokens inside a name are found by trigrams.
    """
    files = sources.select("source", file_tokens(F.col("source")).alias("tokens"), match_text(F.replace(F.regexp_replace("source", r"\.[A-Za-z0-9]+$", ""), F.lit("_"), F.lit(" "))).alias("stem"))
    asked = questions.select("query_id", F.explode(question_tokens(F.col("text"))).alias("token"))
    n = files.agg(F.count("*").alias("n"))
    df = files.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    words = asked.select("token").distinct().join(df, "token", "left").crossJoin(F.broadcast(n))
    words = words.select("token", (1 + F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1))).alias("idf"))
    exact = words.join(files.select("source", F.explode("tokens").alias("token")), "token").select("token", "source", (EXACT * F.col("idf")).alias("part"))
    stems = files.select("source", "stem", F.replace("stem", F.lit(" "), F.lit("")).alias("compact"))
    loose = inside(words.where("char_length(token) >= 3"), stems, ["stem", "compact"])
    loose = loose.select("token", "source", (PARTIAL * F.col("idf")).alias("part"))
    part = exact.unionByName(loose).groupBy("token", "source").agg(F.max("part").alias("part"))
    scored = asked.join(part, "token").groupBy("query_id", "source").agg(F.sum("part").alias("score"), F.count("*").alias("hits"))
    scored = scored.withColumn("score", F.round(F.when(F.col("hits") >= 2, F.col("score") * SEVERAL).otherwise(F.col("score")), 6))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("source"))
    ranked = scored.withColumn("rn", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead("score").over(order), F.lit(0.0)))
    unclear = (F.col("second") > 0) & (F.col("score") - F.col("second") < MARGIN) & (F.col("second") >= 0.8 * LEAST)
    return ranked.where((F.col("rn") == 1) & (F.col("score") >= LEAST) & ~unclear).select("query_id", "source", F.round("score", 4).alias("score"))


def tiers(scored: DataFrame) -> DataFrame:
    """Of each question's scored chunks those of the strictest tier that has any.

    ``scored`` has ``paper_ref, section_ref, table_ref, source, section_id, table_id``. A question for a
    table never leaves it; one that names a paper is never answered from all papers.
    """
    paper, section, table = (F.col(c).isNotNull() for c in ("paper_ref", "section_ref", "table_ref"))
    in_paper = F.contains(F.lower("source"), F.lower("paper_ref"))
    in_section = F.col("section_id").startswith(F.col("section_ref"))
    in_table = F.col("table_id") == F.col("table_ref")
    tier = (
        F.when(table, F.when(in_table & (in_paper | ~paper), 0).when(in_table, 1))
        .when(paper & section & in_paper & in_section, 2)
        .when(paper & in_paper, 3)
        .when(~paper & section & in_section, 4)
        .when(~paper, 5)
    )
    tiered = scored.withColumn("tier", tier.cast("long")).where("tier is not null")
    best = F.min("tier").over(Window.partitionBy("query_id"))
    return tiered.withColumn("best", best).where("tier = best").drop("best")


def table_lock(candidates: DataFrame) -> DataFrame:
    """For a question for a table exactly one chunk, the best of that table; other questions keep all."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    hit = candidates.where(F.col("table_ref").isNull() | (F.col("table_id") == F.regexp_replace("table_ref", r"\.$", "")))
    return hit.withColumn("rn", F.row_number().over(order)).where("table_ref is null or rn = 1").drop("rn")

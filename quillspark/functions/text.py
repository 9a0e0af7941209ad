"""Text functions as Columns. All stay in the JVM, but for Unicode normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[一-鿿]"
#: White space of the tokenizer contract: ASCII only, the same in every engine.
SPACE = r"[ \t\n\r\f]+"

#: Symbols that a text model reads better as words.
SYMBOLS = {"×": "x", "–": "-", "—": "-", "•": ".", "·": ".", "●": "*", "◆": "*", "▶": ">", "◦": ".", "©": "(c)", "®": "(r)", "™": "(tm)", "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "λ": "lambda", "μ": "mu", "σ": "sigma", "θ": "theta", "φ": "phi", "ψ": "psi", "ω": "omega", "≤": "<=", "≥": ">=", "≠": "!=", "±": "+-", "≈": "~=", "∞": "inf", "∀": "for all", "∃": "exists", "→": "->", "←": "<-", "⇒": "=>", "⇔": "<=>"}
#: Common words of four letters and more, at which glued words are cut.
GLUED = ["with", "from", "were", "been", "being", "have", "does", "will", "would", "could", "should", "might", "shall", "need", "dare", "ought", "used", "this", "that", "these", "those", "your", "they", "their", "each", "every", "both", "more", "most", "some", "such", "only", "same", "than", "very", "just", "also", "then", "else", "when", "where", "which", "whom", "what", "while", "although", "because", "since", "until", "after", "before", "between", "under", "over", "through", "during", "without", "within", "about", "against", "into", "throughout", "among", "vision", "medical", "image", "images", "model", "segment", "segmentation", "detection", "classification", "network", "learning", "training", "testing", "validation", "dataset", "data", "feature", "features", "layer", "layers", "input", "output", "kernel", "filter", "pooling", "convolution", "attention", "transformer", "encoder", "decoder", "algorithm", "method", "approach", "framework", "architecture", "performance", "accuracy", "precision", "recall", "score"]
#: A page's stamp, whole and what is left of one.
STAMPS = (r"(?i)ar\s*Xiv:\s*[0-9]{4}\.\s*[0-9]{4,5}v?\s*[0-9]*\s*\[[a-zA-Z\s.\-]+\]\s*[0-9]{1,2}\s+[A-Z][a-z]+\s+[0-9]{4}", r"(?i)ar\s*Xiv:\s*[0-9]{4}\.\s*[0-9]{4,5}v?\s*[0-9]*")
ADDRESS = r"(?:github\.com|gitlab\.com|https?://)\S+"


def null_as_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def tokenize(text: Column) -> Column:
    """Lower-case tokens between white space; a token of CJK letters alone falls into its letters."""
    parts = F.filter(F.split(F.lower(null_as_empty(text)), SPACE, -1), lambda t: t != "")
    letters = F.transform(parts, lambda t: F.when(t.rlike(f"^{CJK}+$"), F.filter(F.split(t, ""), lambda c: c != "")).otherwise(F.array(t)))
    return F.when(null_as_empty(text).rlike(CJK), F.flatten(letters)).otherwise(parts)


def has_cjk(text: Column) -> Column:
    return null_as_empty(text).rlike(CJK)


def token_estimate(text: Column) -> Column:
    """Estimated tokens: two for three CJK letters, one for four other characters."""
    cjk = F.regexp_count(null_as_empty(text), F.lit(CJK))
    return F.floor(cjk / 1.5 + (F.char_length(null_as_empty(text)) - cjk) / 4.0).cast("long")


def paragraphs(text: Column, separator: str = r"\n\s*\n", least: int = 20) -> Column:
    """Trimmed paragraphs of more than ``least`` characters."""
    return F.filter(F.transform(F.split(null_as_empty(text), separator, -1), lambda p: F.trim(p)), lambda p: F.char_length(p) > least)


def title_of(text: Column, lines: int = 10) -> Column:
    """The first of the first lines that is longer than 10 characters and no archive stamp."""
    head = F.slice(F.transform(F.split(null_as_empty(text), "\n", -1), lambda x: F.trim(x)), 1, lines)
    return F.coalesce(F.try_element_at(F.filter(head, lambda x: (F.char_length(x) > 10) & ~x.startswith("arXiv")), F.lit(1)), F.lit(""))


def slug(source: Column, limit: int = 80) -> Column:
    """A folder name for a source file."""
    return F.substring(F.replace(F.replace(source, F.lit(".pdf"), F.lit("")), F.lit(" "), F.lit("_")), 1, limit)


def is_archive_id(stem: Column) -> Column:
    return F.coalesce(stem.rlike(r"^[0-9]{4}\.[0-9]{4,5}([vV][0-9]+)?$"), F.lit(False))


def table_id(caption: Column, fallback: Column) -> Column:
    """``Table_n`` of a caption with an Arabic or Roman number (up to X), else of the fallback number."""
    arabic = F.nullif(F.regexp_extract(caption, r"(?i)table\s*([0-9]+)", 1), F.lit(""))
    roman = F.upper(F.nullif(F.regexp_extract(caption, r"(?i)table\s+(x|ix|iv|v?i{1,3}|v)(?:[^a-z0-9]|$)", 1), F.lit("")))
    number = F.coalesce(arabic, roman_value(roman).cast("string"), fallback.cast("string"))
    return F.concat(F.lit("Table_"), number)


def roman_value(numeral: Column) -> Column:
    """The value of I to X; null for anything else."""
    names = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]
    at = F.array_position(F.array(*map(F.lit, names)), F.upper(numeral))
    return F.when(at > 0, at)


def strip_html(html: Column) -> Column:
    """Text of a page: scripts and tags go, entities of the five marks are resolved, space is collapsed."""
    text = F.regexp_replace(null_as_empty(html), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def links(html: Column) -> Column:
    """Link targets in double, single or no quotes."""
    marked = F.regexp_extract_all(null_as_empty(html), F.lit("""(?i)href\\s*=\\s*("[^"]+"|'[^']+'|[^\\s"'>]+)"""), F.lit(1))
    return F.transform(marked, lambda x: F.regexp_replace(x, """^["']|["']$""", ""))


def link_label(link: Column) -> Column:
    """``code`` for a repository of the two large hosts, else ``link``."""
    return F.when(link.rlike(r"(?i)github\.com|gitlab\.com"), "code").otherwise("link")


def match_text(text: Column) -> Column:
    """Lower case, one spelling of 'sam 2', signs to spaces: what the router compares."""
    low = F.regexp_replace(F.lower(null_as_empty(text)), r"\bsam\s*[-_]?\s*2\b", "sam_2")
    low = F.regexp_replace(low, "[^\\w\\s一-鿿]", " ")
    return F.trim(F.regexp_replace(low, r"\s+", " "))


def date_clause(low: Column, high: Column, field: Column) -> Column:
    """``name:[from TO to]`` with minutes, ``*`` for an open end; empty if both are open."""
    name = F.when(field == "updated", "lastUpdatedDate").otherwise("submittedDate")
    side = lambda d, t: F.coalesce(F.concat(F.date_format(d, "yyyyMMdd"), F.lit(t)), F.lit("*"))
    clause = F.concat(name, F.lit(":["), side(low, "0000"), F.lit(" TO "), side(high, "2359"), F.lit("]"))
    return F.when(low.isNull() & high.isNull(), "").otherwise(clause)


def in_date_range(stamp: Column, low: str | None, high: str | None) -> Column:
    """Whether the stamp's day lies in the closed range; a missing or broken stamp passes."""
    day = F.try_to_date(F.substring(stamp.cast("string"), 1, 10), "yyyy-MM-dd")
    inside = F.lit(True)
    if low:
        inside = inside & (day >= F.lit(low).cast("date"))
    if high:
        inside = inside & (day <= F.lit(high).cast("date"))
    return F.coalesce(inside, F.lit(True))


def without_stamps(text: Column) -> Column:
    """The text without page stamps of an archive."""
    for pattern in STAMPS:
        text = F.regexp_replace(text, pattern, "")
    return text


def unglue(text: Column, passes: int = 2) -> Column:
    """Repair text whose spaces were lost: page stamps go, web addresses are set apart and left alone, the rest is cut between
    small and capital letters, letters and digits, digits and capitals, a stop and a capital, brackets and letters, and at
    common words that others are glued to."""
    text = without_stamps(null_as_empty(text))
    text = F.regexp_replace(text, r"([a-zA-Z0-9])(?=github\.com|gitlab\.com|https?://)", "$1 ")
    by_length = sorted(GLUED, key=len, reverse=True)
    small, capital = "|".join(by_length), "|".join(w.capitalize() for w in by_length)
    long = "|".join(w for w in by_length if len(w) >= 5)
    steps = [
        (r"([a-z])(?=[A-Z])", "$1 "), (r"([a-zA-Z])(?=[0-9])", "$1 "), (r"([0-9])(?=[A-Z])", "$1 "), (r"\.(?=[A-Z])", ". "), (r"([\])}])(?=[a-zA-Z])", "$1 "), (r"([a-zA-Z0-9])(?=[\[(])", "$1 "),
        *[(rf"(?<![a-zA-Z])({small})(?=[a-zA-Z]{{4,}})", "$1 "), (rf"(?<![a-zA-Z])({capital})(?=[a-z]{{4,}})", "$1 "), (rf"([A-Z])({small})(?=[a-z]{{4,}})", "$1 $2 ")] * passes,
        *[(rf"([a-z])({long})(?=[a-z]{{5,}})", "$1 $2 ")] * passes,
    ]

    def repaired(part: Column) -> Column:
        for pattern, new in steps:
            part = F.regexp_replace(part, pattern, new)
        return part

    parts = F.transform(F.split(text, ADDRESS, -1), repaired)
    kept = F.concat(F.regexp_extract_all(text, F.lit(f"({ADDRESS})"), F.lit(1)), F.array(F.lit("")))
    return F.array_join(F.zip_with(parts, kept, lambda a, b: F.concat(a, b)), "")


def embed_text(paper: Column, section: Column, before: Column, text: Column, limit: int = 4096) -> Column:
    """What the embedder reads of a chunk: ``[paper] | Section: s | Prev: first sentence | text``, cut, without broken characters."""
    part = lambda c, made: F.when(F.coalesce(c, F.lit("")) != "", made)
    whole = F.concat_ws(" | ", part(paper, F.concat(F.lit("["), paper, F.lit("]"))), part(section, F.concat(F.lit("Section: "), section)), part(before, F.concat(F.lit("Prev: "), first_sentence(before))), null_as_empty(text))
    return F.substring(F.translate(whole, "\x00\ufffd", "  "), 1, limit)


def salvaged_json(text: Column, schema: str) -> Column:
    """A JSON object inside other text, from the first ``{`` to the last ``}``; null if that is none."""
    found = F.regexp_extract(null_as_empty(text), r"(?s)(\{.*\})", 1)
    return F.when(found != "", F.from_json(found, schema))


def integer_list(text: Column) -> Column:
    """The whole numbers of the first list of numbers in a text; empty without one."""
    first = F.regexp_extract(null_as_empty(text), r"\[\s*([0-9]+(?:\s*,\s*[0-9]+)*)\s*\]", 1)
    return F.transform(F.filter(F.split(first, r"\s*,\s*"), lambda x: x != ""), lambda x: x.cast("int"))


def with_defaults(given: Column, defaults: Column) -> Column:
    """Two string maps as one in which ``given`` wins."""
    missing = F.map_filter(defaults, lambda k, v: ~F.coalesce(F.map_contains_key(given, k), F.lit(False)))
    return F.map_concat(missing, F.coalesce(given, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))


def plain_symbols(text: Column) -> Column:
    for symbol, word in SYMBOLS.items():
        text = F.replace(text, F.lit(symbol), F.lit(word))
    return text


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition, which Spark has no function for."""

    def composed(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(composed, "string")(text)


def file_stem(title: Column, limit: int = 120) -> Column:
    """A safe file name stem of a title; ``paper`` if nothing is left."""
    text = F.regexp_replace(nfkc(F.trim(null_as_empty(title))), r'[<>:"/\\|?*\x00-\x1f]', "")
    text = F.regexp_replace(text, r"(?U)[\s　]+", "_")
    text = F.regexp_replace(text, r"(?U)[^\w.\-]+", "_")
    text = F.regexp_replace(F.regexp_replace(text, "_+", "_"), r"^[._]+|[._]+$", "")
    text = F.regexp_replace(F.substring(text, 1, limit), r"[._]+$", "")
    return F.when(text == "", "paper").otherwise(text)


def first_sentence(text: Column, limit: int = 150) -> Column:
    return F.substring(F.substring_index(null_as_empty(text), ". ", 1), 1, limit)


def shorten(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)

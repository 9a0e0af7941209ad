"""Quality rules with tokeniser fertility.

Two public vocabularies are run over every word: one with byte fallback and one of byte pairs. Per document the first gives the
characters per token, the share of byte-fallback tokens and the entropy of its tokens
(relative to the greatest for that many tokens), the second the characters per token and the share of tokens that are broken characters. Each language has a rejection band for each
measure: the quartiles of all its documents that pass the base rules, widened by ``fence``
interquartile ranges (two thirds of them for the entropy, whose end would else pass its bound of 1, and eight times as many
for broken characters, which are few in most languages). Only where
the quartiles are equal a fixed width is taken. Bands come from all rows: quartiles are exact on a grid of 1/10 000,
from counts by language and grid point, so neither partitions nor their order change a verdict.
Every language has its own band at every number of documents: the fixed width is added with the
weight exp(-documents / ``least_docs``), so nothing switches at a count.

Defined cases: null text has no word and fails the base rules; subtags of a language code are
dropped (``pt-BR`` is ``pt``); a document with a null, odd or ``und`` code counts by the script of most
of its letters (``und-latin``, or ``und`` without a letter); a language without a document that passes
the base rules has no band; repeated rows count each; a very long text takes memory in proportion to its words and tokens; an empty table gives no row.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, column, map_arrow, pick, portions, whole_text, written

_LOADED: dict[tuple[str, str, str], "PieceTable"] = {}
#: measure -> its part of ``fence``, and the width of its band where the quartiles are equal.
MEASURES = {"chars_per_token": (1.0, 0.5), "byte_share": (1.0, 0.05), "entropy": (2 / 3, 0.08), "pair_chars_per_token": (1.0, 0.5), "pair_byte_share": (8.0, 0.05)}
#: Grid points of the quartiles for one unit of a measure.
GRID = 10_000


class PieceTable(dict):
    """word -> index; by index the word's code points, tokens and byte-fallback tokens."""

    def __init__(self, path: str, pair_path: str, pattern: str, limit: int = 400_000):
        import sentencepiece
        import tiktoken

        from .bpe import load_ranks

        super().__init__()
        ranks = load_ranks(pair_path)
        self.pairs = tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.broken = set()
        for token, rank in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                self.broken.add(rank)
        self.limit = limit
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        self.is_byte = [self.model.is_byte(i) for i in range(n)]
        self.vocab = n
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.points, self.tokens, self.bytes = array("i"), array("i"), array("i")
        self.first, self.arena = array("q"), array("i")
        self.pair_tokens, self.pair_broken = array("i"), array("i")

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        ids = self.model.encode(text, num_threads=1)
        at = self[word] = len(self)
        self.points.append(len(text))
        self.tokens.append(len(ids))
        self.bytes.append(sum(self.is_byte[i] for i in ids))
        self.first.append(len(self.arena))
        self.arena.extend(ids)
        pairs = self.pairs(f" {text}")
        self.pair_tokens.append(len(pairs))
        self.pair_broken.append(sum(i in self.broken for i in pairs))
        return at


def repeated_words(words: np.ndarray, window: int = 3) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the document."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    base = int(words.max()) + 1
    if base ** window < 2**63:
        keys = words[:n].astype(np.int64)
        for k in range(1, window):
            keys = keys * base + words[k : k + n]
    else:
        keys = np.unique(np.stack([words[k : k + n] for k in range(window)], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + window - 1, dtype=bool)
    for k in range(window):
        covered[k : k + n] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def script(text: bytes, known: dict[str, str]) -> str:
    """The script of most letters (the first word of their Unicode names; kana count as one), or the empty text."""
    found: Counter = Counter()
    for letter, n in Counter(text.decode("utf-8", "replace")).items():
        name = known.get(letter)
        if name is None:
            name = unicodedata.name(letter, "").split(" ")[0].split("-")[0].lower() if letter.isalpha() else ""
            name = known[letter] = "kana" if name in ("hiragana", "katakana") else name
        found[name] += n
    found.pop("", None)
    return min(found, key=lambda name: (-found[name], name), default="")


def measure(df: DataFrame, model_path: str, pair_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", symbols: bytes = b"#*$%&|<>") -> DataFrame:
    """Base counts and fertility measures of every document."""
    rows = pick(df, id=id_col, text=text_col, **({"lang": lang_col} if lang_col else {}))
    lang = F.lower(F.col("lang").cast("string")) if lang_col else F.lit(None).cast("string")
    # At most 26**2 + 26**3 codes and Unicode's scripts, so the table of bands is small whatever the input.
    code = F.regexp_extract(F.trim(lang), "^([a-z]{2,3})([-_].*)?$", 1)
    rows = rows.select("id", whole_text(F.col("text")).alias("text"), F.when(code != "", code).otherwise("und").alias("lang"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double, pair_chars_per_token double, pair_byte_share double"
    names = [x.split()[0] for x in schema.split(", ")]

    def start():
        if (model_path, pair_path, pattern) not in _LOADED:
            _LOADED[model_path, pair_path, pattern] = PieceTable(model_path, pair_path, pattern)
        table = _LOADED[model_path, pair_path, pattern]
        scripts: dict[str, str] = {}

        def step(batch: pa.RecordBatch):
            texts = as_bytes(batch, "text")
            for lo, hi in portions(texts, 256):
                part = texts[lo:hi]
                if len(table) >= table.limit:
                    table.reset()
                words = [np.fromiter(map(table.__getitem__, t.split()), dtype=np.int64) for t in part]
                points, tokens, bytes_, first, pair_tokens, pair_broken = (np.array(x) for x in (table.points, table.tokens, table.bytes, table.first, table.pair_tokens, table.pair_broken))
                arena = np.array(table.arena)
                out: list[list] = [[] for _ in names[2:]]
                for text, w in zip(part, words):
                    lengths = tokens[w]
                    n, chars = int(lengths.sum()), int(points[w].sum())
                    per_token = share = entropy = per_pair = broken = None
                    if n:
                        ends = np.cumsum(lengths)
                        ids = arena[np.repeat(first[w] - ends + lengths, lengths) + np.arange(n)]
                        counts = np.bincount(ids)
                        counts = counts[counts > 0]
                        per_token, share = chars / n, int(bytes_[w].sum()) / n
                        bits = np.log2(n) - float((counts * np.log2(counts)).sum()) / n
                        entropy = float(bits / np.log2(min(n, table.vocab))) if n > 1 else 0.0
                        pairs = int(pair_tokens[w].sum())
                        per_pair, broken = chars / pairs, int(pair_broken[w].sum()) / pairs
                    row = (len(w), chars, len(text) - len(text.translate(None, symbols)), duplicate_lines(text), repeated_words(w), n, per_token, share, entropy, per_pair, broken)
                    for col, value in zip(out, row):
                        col.append(value)
                kinds = [pa.int64()] * 6 + [pa.float64()] * 5
                codes = column(batch, "lang").slice(lo, hi - lo).to_pylist()
                langs = [f"und-{script(t, scripts)}".rstrip("-") if c == "und" else c for c, t in zip(codes, part)]
                yield pa.RecordBatch.from_arrays([column(batch, "id").slice(lo, hi - lo), pa.array(langs, pa.string()), *(pa.array(c, k) for c, k in zip(out, kinds))], names=names)

        return step

    return map_arrow(rows, schema, start)


def quartiles(measured: DataFrame) -> DataFrame:
    """``lang, docs`` and for each measure ``_q1, _q3``: the least grid points that a quarter and three quarters of the documents don't exceed."""
    sound = measured.where("not base_failed and n_tokens > 0")
    each = sound.select("lang", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.round(F.col(m) * GRID).cast("long").alias("at")) for m in MEASURES])).alias("x")).select("lang", "x.*")
    counts = each.groupBy("lang", "m", "at").agg(F.count("*").alias("n"))
    group = Window.partitionBy("lang", "m")
    summed = counts.withColumns({"upto": F.sum("n").over(group.orderBy("at")), "docs": F.sum("n").over(group)})  # grid points, however many documents
    at = lambda m, share: (F.min(F.when((F.col("m") == m) & (F.col("upto") >= share * F.col("docs")), F.col("at"))) / GRID)
    return summed.groupBy("lang").agg(F.max("docs").alias("docs"), *[at(m, q).alias(f"{m}_{name}") for m in MEASURES for name, q in (("q1", 0.25), ("q3", 0.75))])


def bands(measured: DataFrame, fence: float, least_docs: int) -> DataFrame:
    """``lang`` and a low and high end for each measure."""
    out = []
    for name, (part, flat) in MEASURES.items():
        q1, q3 = F.col(f"{name}_q1"), F.col(f"{name}_q3")
        few = F.when(q3 > q1, F.exp(-F.col("docs") / least_docs)).otherwise(1.0)
        spread = part * fence * (q3 - q1) + flat * few
        out += [(q1 - spread).alias(f"{name}_lo"), (q3 + spread).alias(f"{name}_hi")]
    return quartiles(measured).select("lang", *out)


def judge(df: DataFrame, model_path: str, pair_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", min_words: int = 50, max_repeat_percent: int = 50, fence: float = 3.0, least_docs: int = 100) -> DataFrame:
    """Every document's counts, measures, ``base_failed``, ``kept`` and the measure that failed first."""
    measured = measure(df, model_path, pair_path, pattern, id_col, text_col, lang_col).withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    )
    measured = written(measured, "fertility")  # numbers only; the bands and the verdicts read it
    found = bands(measured, fence, least_docs)
    # The bands are bounded by the number of codes and scripts.
    joined = measured.join(F.broadcast(found), "lang", "left")
    outside = [F.when((F.col(m) < F.col(f"{m}_lo")) | (F.col(m) > F.col(f"{m}_hi")), F.lit(m)) for m in MEASURES]
    failed = F.coalesce(*outside)
    return joined.select(
        *measured.columns, failed.alias("failed_band"), (~F.col("base_failed") & failed.isNull()).alias("kept")
    )

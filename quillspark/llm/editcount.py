"""Edit-aware token counts.

Per document a segment tree is kept over blocks of pre-tokens: its nodes hold the sums of
characters and of tokens below. An edit re-encodes only the pre-tokens it touches and their
boundary context, and updates the sums on the way to the root.

Why the context suffices: matching a pre-token looks at most two characters beyond its end (a
contraction's letters, the negative look-ahead after white space) and never back. So all
pre-tokens that end two or more characters before the edit stand; matching restarts at the
first that does not. Once a new boundary right of the edit falls on an old one, the text from
there on is the old text, and so are its pre-tokens.

Trees are kept: ``trees`` gives a table of them (two arrays of numbers beside the text), ``edited`` takes such a table and a batch
of edits and gives the next one, so an edit tomorrow costs what it touches, not an encoding of the document. The
edits of a batch are applied together: the text is put together once, and stretches that grow into each other are encoded as one.

Defined cases: null text is the empty text (0 tokens); null or empty edits change nothing;
edits beyond the text's end are cut to it, and a null replacement is a deletion; of overlapping edits of one batch each
is applied to the text that the ones before it left; a text of millions of characters takes memory in proportion, and a batch of any
number of edits time in proportion to the text and what it touches; repeated rows
are counted each on their own; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load_ranks
from .common import BoundedCache, column, map_arrow, pick, whole_text

CONTEXT = 2
BLOCK = 64


class Counter:
    """Pre-token matching and token counts under a rank file."""

    def __init__(self, path: str, pattern: str, cached: int = 400_000):
        import regex
        import tiktoken

        coder = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        self.pattern = regex.compile(pattern)
        self.encode = coder.encode_ordinary
        self.cache = BoundedCache(cached)

    def count(self, piece: str) -> int:
        found = self.cache.get(piece)
        if found is None:
            found = len(self.encode(piece))
            if len(piece) <= 64:
                self.cache.room()
                self.cache[piece] = found
        return found


class PretokenTree:
    """A text, its pre-tokens in blocks, and a segment tree of (characters, tokens) over the blocks."""

    def __init__(self, text: str, counter: Counter):
        pieces = counter.pattern.findall(text)
        self._start(text, counter, list(map(len, pieces)), list(map(counter.count, pieces)))

    @classmethod
    def kept(cls, text: str, counter: Counter, lengths: list[int], counts: list[int]) -> "PretokenTree":
        """The tree of a text from the lengths and counts of its pre-tokens: nothing is encoded."""
        tree = cls.__new__(cls)
        tree._start(text, counter, lengths, counts)
        return tree

    def _start(self, text: str, counter: Counter, lengths: list[int], counts: list[int]) -> None:
        self.text, self.counter, self.encoded = text, counter, 0
        self._build(lengths, counts)

    def flat(self) -> tuple[list[int], list[int]]:
        """Lengths and counts of all pre-tokens, in order."""
        return [x for y, _ in self.blocks for x in y], [x for _, y in self.blocks for x in y]

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        self.blocks = [(lengths[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(lengths), BLOCK)] or [([], [])]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (n, c) in enumerate(self.blocks):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(n), sum(c)
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def pretokens(self) -> int:
        return sum(len(n) for n, _ in self.blocks)

    def _find(self, at: int) -> tuple[int, int, int]:
        """Block, place in it and start of the pre-token that holds character ``at``; past the last one at the text's end."""
        node, start = 1, 0
        if at >= self.chars[1]:
            last = len(self.blocks) - 1
            return last, len(self.blocks[last][0]), self.chars[1]
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        block, place = node - self.size, 0
        for place, n in enumerate(self.blocks[block][0]):
            if at < start + n:
                break
            start += n
        return block, place, start

    def edit(self, start: int, end: int, replacement: str) -> int:
        """Replace the characters [start, end); returns the number of pre-tokens encoded for it."""
        return self.edit_all([(start, end, replacement)])

    def edit_all(self, edits: list[tuple[int, int, str]]) -> int:
        """Replace stretches of the present text, by start and apart from each other; returns the number of pre-tokens encoded."""
        size, at, parts, todo = len(self.text), 0, [], []
        for start, end, new in edits:
            start = min(max(start, at), size)
            end = min(max(end, start), size)
            todo.append((start, end, len(new)))
            parts += [self.text[at:start], new]
            at = end
        self.text = "".join([*parts, self.text[at:]])
        splices, shift, i, done = [], 0, 0, 0
        while i < len(todo):
            block, place, here = self._find(max(todo[i][0] - CONTEXT, 0))
            first, old = (block, place), here  # ``old``: the end, in the old text, of the old pre-tokens given up so far
            here += shift
            settled = end = -1
            lengths: list[int] = []
            counts: list[int] = []
            matches = self.counter.pattern.finditer(self.text, here)
            while True:
                while i < len(todo) and (end < 0 or here + CONTEXT >= todo[i][0] + shift):  # the stretch reaches the next edit
                    start, end, length = todo[i]
                    settled = start + shift + length
                    shift += length - (end - start)
                    i += 1
                if here >= settled:
                    while old < here - shift and block < len(self.blocks):
                        if place < len(self.blocks[block][0]):
                            old += self.blocks[block][0][place]
                            place += 1
                        else:
                            block, place = block + 1, 0
                    if old == here - shift and old >= end:
                        break
                found = next(matches, None)
                if found is None:
                    block, place = len(self.blocks), 0
                    break
                here += len(found.group())
                lengths.append(len(found.group()))
                counts.append(self.counter.count(found.group()))
            splices.append((first, (block, place), lengths, counts))
            done += len(lengths)
            if block == len(self.blocks):
                break
        for splice in reversed(splices):  # places left of a splice stand
            self._splice(*splice)
        if any(len(n) > 4 * BLOCK for n, _ in self.blocks):
            self._build(*self.flat())
        self.encoded += done
        return done

    def _splice(self, first: tuple[int, int], last: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        (b, p), (c, q) = first, last
        rest = ([], []) if c >= len(self.blocks) else tuple(x[q:] for x in self.blocks[c])
        n, k = self.blocks[b]
        if b == c:
            n[p:q], k[p:q] = lengths, counts
        else:
            n[p:], k[p:] = lengths, counts
            for i in range(b + 1, min(c, len(self.blocks))):
                self.blocks[i] = ([], [])
            if c < len(self.blocks):
                self.blocks[c] = rest
        touched = set()
        for i in range(b, min(c, len(self.blocks) - 1) + 1):
            leaf = self.size + i
            self.chars[leaf], self.tokens[leaf] = sum(self.blocks[i][0]), sum(self.blocks[i][1])
            touched.add(leaf // 2)
        while touched and touched != {0}:
            for node in touched:
                self._sum(node)
            touched = {node // 2 for node in touched if node > 1}


#: What a clean-up pass rewrites: mail addresses and long digit runs.
#: A name is tried from its first character only, so a long run without an at sign costs one pass.
_PRIVATE = re.compile(r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*|(?<![0-9])[0-9]{7,}").finditer


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that mask mail addresses and runs of seven or more digits."""
    return [(m.start(), m.end(), "[mail]" if "@" in m.group() else "[number]") for m in _PRIVATE(text)]


def header(text: str) -> list[tuple[int, int, str]]:
    """The edit that puts a first line before the text."""
    return [(0, 0, "Document\n")]


_LOADED: dict[tuple[str, str], Counter] = {}


def _counter(ranks_path: str, pattern: str) -> Counter:
    if (ranks_path, pattern) not in _LOADED:
        _LOADED[ranks_path, pattern] = Counter(ranks_path, pattern)
    return _LOADED[ranks_path, pattern]


def _packed(values: list[int]) -> bytes:
    return np.array(values, dtype="<u4").tobytes()


def trees(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """``id, text, lengths, counts, n_tokens``: each document with the lengths and token counts of its pre-tokens (little-endian unsigned 32-bit).

    A column of edits goes along as ``edits``.
    """
    rows = pick(df, id=id_col, text=text_col, **({"edits": edits_col} if edits_col else {})).withColumn("text", whole_text(F.col("text")))
    more = ["edits"] if edits_col else []
    also = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in more)

    def start():
        counter = _counter(ranks_path, pattern)

        def step(batch: pa.RecordBatch):
            for lo in range(0, batch.num_rows, 256):
                part, out = batch.slice(lo, 256), []
                for text in column(part, "text").to_pylist():
                    pieces = counter.pattern.findall(text)
                    counts = list(map(counter.count, pieces))
                    out.append((_packed(list(map(len, pieces))), _packed(counts), sum(counts)))
                a, b, n = zip(*out)
                yield pa.RecordBatch.from_arrays([column(part, "id"), column(part, "text"), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64()), *(column(part, c) for c in more)], names=["id", "text", "lengths", "counts", "n_tokens", *more])

        return step

    return map_arrow(rows, f"id {rows.schema['id'].dataType.simpleString()}, text string, lengths binary, counts binary, n_tokens long{also}", start)


def edited(kept: DataFrame, ranks_path: str, pattern: str, edits: Callable[[str], list[tuple[int, int, str]]] | str, more: list[str] | None = None) -> DataFrame:
    """The trees after a batch of edits, with ``n_before, n_edits, n_reencoded`` and the columns of ``kept`` named in ``more``.

    ``edits`` gives a text's edits, or names a column of ``kept``: an array of (start, end, text), in order, each
    for the text that the one before it left.
    """
    more = more or []
    given = edits if isinstance(edits, str) else None
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"id {kinds['id']}, text string, lengths binary, counts binary, n_tokens long, n_before long, n_edits long, n_reencoded long" + "".join(f", {c} {kinds[c]}" for c in more)
    names = ["id", "text", "lengths", "counts", "n_tokens", "n_before", "n_edits", "n_reencoded", *more]

    def start():
        counter = _counter(ranks_path, pattern)

        def one(text: str, lengths: bytes, counts: bytes, n: int, asked: list | None) -> tuple:
            todo = edits(text) if given is None else [(e["start"] or 0, e["end"] or 0, e["text"] or "") for e in asked or () if e is not None]
            if not todo:
                return text, lengths, counts, n, n, 0, 0
            tree = PretokenTree.kept(text, counter, np.frombuffer(lengths, "<u4").tolist(), np.frombuffer(counts, "<u4").tolist())
            if given is None:
                tree.edit_all(todo)
            else:
                for lo, hi, new in todo:
                    tree.edit(lo, hi, new)
            after = tree.flat()
            return tree.text, _packed(after[0]), _packed(after[1]), tree.total, n, len(todo), tree.encoded

        def step(batch: pa.RecordBatch):
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                asked = column(part, given).to_pylist() if given else [None] * part.num_rows
                out = zip(*(one(*row) for row in zip(*(column(part, c).to_pylist() for c in ("text", "lengths", "counts", "n_tokens")), asked)))
                types = [pa.string(), pa.binary(), pa.binary()] + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([column(part, "id"), *(pa.array(c, t) for c, t in zip(out, types)), *(column(part, c) for c in more)], names=names)

        return step

    return map_arrow(kept, schema, start)


def count_edited(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """Token counts before and after each document's edits.

    ``edits_col`` is an array of (start, end, text), applied in order, each to the text that the
    one before it left; without it the edits are ``redactions``. Returns ``id, n_pretokens,
    n_tokens, n_edits, n_reencoded, n_tokens_after, n_chars_after``.
    """
    first = trees(df, ranks_path, pattern, id_col, text_col, edits_col)
    pieces = (F.octet_length("lengths") / 4).cast("long").alias("n_pretokens")
    counted = edited(first.withColumn("n_pretokens", pieces), ranks_path, pattern, "edits" if edits_col else redactions, ["n_pretokens"])
    return counted.select("id", "n_pretokens", F.col("n_before").alias("n_tokens"), "n_edits", "n_reencoded", F.col("n_tokens").alias("n_tokens_after"), F.char_length("text").cast("long").alias("n_chars_after"))

"""Byte-level BPE by longest matches with backtracking.

Bytes are mapped to Latin-1 so that one Aho-Corasick automaton finds every vocabulary entry in
a pre-token. Encoding walks from left to right and takes the longest entry; two adjacent tokens
are compatible when merging their joint bytes gives back exactly these two, a fact that is
memoised by pair. If no compatible token fits, the walk backtracks, and a position that turned
out dead is never tried again. A sequence whose tokens are all reachable by merges and whose
adjacent pairs are all compatible is the merge result itself, so ids equal those of the merges.

Defined cases: null text is the empty text (no ids); repeated rows are encoded each on their
own; a very long text takes time and memory in proportion, a very long pre-token too; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, column, map_arrow, pick, portions, whole_text

#: White space as the pre-token pattern's \\s has it (Unicode White_Space).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs between which a pattern that takes at most one leading space into a word always splits.
CHUNKS = rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

_LOADED: dict[tuple[str, str], "ByteBpe"] = {}


def _le32(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_all(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the adjacent pair of least rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class ByteBpe:
    """Encoder and decoder for one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str, chunks: str | None = CHUNKS, cached: int = 400_000):
        """``chunks`` splits a text where ``pattern`` splits it in any case; None if there's no such rule."""
        import ahocorasick
        import regex

        self.ranks = load_ranks(path)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.find = regex.compile(pattern).findall
        self.chunks = re.compile(chunks or r"(?s:.+)").findall
        self.pairs = BoundedCache(1_000_000)
        self.reachable: dict[int, bool] = {}
        self.pieces = BoundedCache(cached)

    def _token_ok(self, token: int) -> bool:
        found = self.reachable.get(token)
        if found is None:
            found = self.reachable[token] = merge_all(self.bytes_of[token], self.ranks) == [token]
        return found

    def _pair_ok(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            self.pairs.room()
            found = self.pairs[key] = merge_all(self.bytes_of[left] + self.bytes_of[right], self.ranks) == [left, right]
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token; a pre-token that is an entry itself is that entry."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        size = len(piece)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for last, entry in self.automaton.iter(piece.decode("latin-1")):
            starts[last + 1 - entry[1]].append(entry)  # ends ascend, so lengths at a start do too
        dead = bytearray(size + 1)
        tokens: list[int] = []
        ends: list[int] = []
        at = 0
        while at < size:
            options = starts[at]
            while options:
                token, length = options.pop()  # the longest that is left
                if not dead[at + length] and self._token_ok(token) and (not tokens or self._pair_ok(tokens[-1], token)):
                    tokens.append(token)
                    ends.append(at)
                    at += length
                    break
            else:
                if not tokens:
                    raise ValueError("the vocabulary lacks a byte")
                dead[at] = 1
                tokens.pop()
                at = ends.pop()
        return tokens

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        cache, out = self.pieces, []
        for chunk in self.chunks(text):
            found = cache.get(chunk)
            if found is None:
                found = _le32([i for piece in self.find(chunk) for i in self.encode_piece(piece.encode())])
                if len(chunk) <= 64:
                    cache.room()
                    cache[chunk] = found
            out.append(found)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        lookup = self.bytes_of
        return b"".join([lookup[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def loaded(path: str, pattern: str) -> ByteBpe:
    """One encoder per worker process, kept between tasks."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def encode_table(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids binary, decoded binary``: a text's token ids and the bytes they decode to."""
    rows = pick(df, id=id_col, text=text_col).withColumn("text", whole_text(F.col("text")))

    def start():
        bpe = loaded(ranks_path, pattern)

        def step(batch: pa.RecordBatch):
            ids_of, texts = column(batch, "id"), column(batch, "text").to_pylist()
            for lo, hi in portions(texts, 512):
                ids = [bpe.encode(t) for t in texts[lo:hi]]
                yield pa.RecordBatch.from_arrays([ids_of.slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())], names=["id", "ids", "decoded"])

        return step

    return map_arrow(rows, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, decoded binary", start)

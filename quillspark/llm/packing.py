"""Sum-of-squares online packing of token streams into fixed windows.

Every document becomes a stream of token ids that ends in a separator. Full windows are cut
off first; the rest (shorter than a window) is an item for the online packer, which keeps a
level array ``N`` with ``N[h]`` open windows filled to ``h`` and puts an item of size ``s`` at
the level that makes the sum of squared counts least. Each scan partition packs on its own, so
nothing is shuffled and memory holds the open windows of one partition only; what is still
open at the end is merged by cutting, so a partition pads one window at most.

Defined cases: null text is the empty text and gives the separator alone; repeated rows are
packed each on their own; a very long text is cut into windows as it is, its ids in memory at once; an empty table gives no piece; other columns are not looked at.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column, pick, whole_text

SCHEMA = "id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class WordTokens(dict):
    """Ids of a tokenizer file whose pre-tokens never span ASCII white space, cached by word.

    The file's merges are run by a rank table: a word's end is written as byte 0xFF, which is no
    byte of UTF-8, and joining a last byte with it has the lowest ranks. Normalisation beyond
    ASCII is the tokenizer's own.
    """

    def __init__(self, path: str, limit: int = 400_000):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.limit = limit
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        byte_of = {c: b for b, c in enumerate(_byte_letters())}

        def raw(token: str) -> bytes:
            last = token.endswith(end) and token != end
            return bytes(byte_of[c] for c in (token[: -len(end)] if last else token)) + b"\xff" * last

        ranks = {bytes([b]): b for b in range(256)}
        self.ids = [vocab.get(c, -1) for c in _byte_letters()]
        finals = [(c + end, bytes([b, 255])) for c, b in byte_of.items() if c + end in vocab]
        merged = [("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in spec["model"]["merges"]]
        for token, key in [*finals, *((m, raw(m)) for m in merged)]:
            if key not in ranks:
                ranks[key] = len(self.ids)
                self.ids.append(vocab[token])
        self.piece = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def __missing__(self, word: bytes) -> bytes:
        table = self.ids
        if word.isalpha():  # of bytes: ASCII letters only, so one pre-token
            found = np.array([table[i] for i in self.piece(word.lower() + b"\xff")], dtype="<u4").tobytes()
        else:
            text = word.decode("utf-8", "replace")
            text = text.lower() if text.isascii() else self.tokenizer.normalizer.normalize_str(text)
            found = np.array([table[i] for p in self.split(text) for i in self.piece(p.encode() + b"\xff")], dtype="<u4").tobytes()
        if len(self) >= self.limit:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found

    def __call__(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        return b"".join(map(self.__getitem__, text.split()))


_LOADED: dict[str, WordTokens] = {}


def _loaded(path: str) -> WordTokens:
    """One table per worker process, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class SumOfSquares:
    """The level array and the open windows; ``place`` returns a window when it is full."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[deque] = [deque() for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The fill level to place an item of ``size`` at; 0 opens a window. Ties: the fullest."""
        top = self.window - size
        # Change of the sum of N[h]^2 over the levels 1..window-1, less the constant 2.
        change = 2 * (self.count[size : self.window + 1] - self.count[: top + 1])
        change[0] = 2 * self.count[size] - 1
        change[top] = -2 * self.count[top] - 1 if top else change[0]
        change[1:][self.count[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return int(top - np.argmin(change[::-1]))

    def place(self, piece: tuple, size: int) -> list | None:
        level = self.level_for(size)
        if level:
            pieces = self.open[level].popleft()
            self.count[level] -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.open[level + size].append(pieces)
        self.count[level + size] += 1
        return None

    def rest(self) -> list[list]:
        """What is open, fullest first."""
        return [pieces for level in range(self.window, 0, -1) for pieces in self.open[level]]


def pack(df: DataFrame, tokenizer_path: str, window: int = 2048, separator: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of packed sequences: ``id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit integers; ``start`` counts
    the document's ids before the piece; ``offset`` is the piece's place in its sequence.
    ``sequence_id`` holds the partition in its upper bits, so it is unique without coordination.
    """
    rows = pick(df, id=id_col, text=text_col).withColumn("text", whole_text(F.col("text")))
    id_type = rows.schema["id"].dataType.simpleString()
    end = np.asarray([separator], dtype="<u4").tobytes()

    def run(batches):
        tokens, packer = _loaded(tokenizer_path), SumOfSquares(window)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        out: list[tuple] = []
        id_arrow = None

        def close(pieces: list) -> None:
            nonlocal sequence
            at = 0
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                out.append((doc, start, n, ids, total, sequence, at))
                at += n
            sequence += 1

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[] for _ in names]
            out.clear()
            kinds = [id_arrow, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=names)

        for b in batches:
            id_arrow = column(b, "id").type
            for doc, text in zip(column(b, "id").to_pylist(), as_bytes(b, "text")):
                ids = tokens(text) + end
                total = len(ids) // 4
                whole = total - total % window
                for start in range(0, whole, window):
                    close([(doc, start, ids[4 * start : 4 * (start + window)], total)])
                if total > whole:
                    full = packer.place((doc, whole, ids[4 * whole :], total), total - whole)
                    if full is not None:
                        close(full)
                if len(out) >= 4096:
                    yield batch()
        gathered, size = [], 0
        for pieces in packer.rest():
            for doc, start, ids, total in pieces:
                while size + len(ids) // 4 >= window:
                    cut = window - size
                    gathered.append((doc, start, ids[: 4 * cut], total))
                    close(gathered)
                    gathered, size, start, ids = [], 0, start + cut, ids[4 * cut :]
                if ids:
                    gathered.append((doc, start, ids, total))
                    size += len(ids) // 4
        if gathered:
            close(gathered)
        if out:
            yield batch()

    return rows.mapInArrow(run, SCHEMA.format(id_type=id_type))

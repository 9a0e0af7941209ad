"""Exact substring deduplication by prefix-partitioned suffix trees.

A window is ``window`` consecutive words of one document. A word goes when some window over it
starts elsewhere too, in any document. The suffixes that matter are found and grouped so:

1. Sampling. Windows that repeat within one document are found there, by sorting its windows, and the first of them stands
   for all. Every window has ``window - gram + 1`` grams; the grams with the least hash are its
   anchors. Equal windows have equal anchors at equal places, so it suffices to compare
   suffixes that start at anchors (about a tenth of all positions).
2. Prefixes. Suffixes are split by their prefix, the anchor gram. A prefix that occurs once
   has no repeat and is dropped by a count with map-side sums.
3. Longer prefixes. A group of more than ``group_limit`` suffixes is split again. All windows that start between x and y words
   before the anchor share the words from x before it up to y words short of a window after it; the nearer x
   and y, the longer these are. So a large group is dealt out by ranges of starts, each with its longer
   common words as prefix: ranges of ``steps`` starts, one step after another, until a group fits. At the
   last step (one start) the prefix is the whole window, the group a single leaf, and its count decides.
4. Subtrees. Each group that fits is small. Its suffixes, cut to the window, are sorted; the
   lengths of common prefixes of neighbours are the inner nodes of the group's suffix tree. The
   text left of each anchor gives a second tree. A pair of nodes whose depths sum up to the window is a
   maximal repeat of that length or more; all windows below a pair with two leaves repeat.

The windows found are gathered by document and the words under them are removed. Texts are
shuffled once (both joins share the exchange).

Hashes only bring suffixes together. Whether windows are equal is decided by their words: trees compare the words
themselves, repeats inside a document are compared word by word, and a leaf is named by 128 bits of the SHA-256
of its words, as is a single word of more than 128 bytes inside a tree.

Defined cases: null text has no word; texts shorter than a window keep all words; equal rows
repeat each other, so all their windows go; null ids are a value like others; very long texts take memory in
proportion to their own length; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import as_bytes, column, discard, lean, lookup, map_arrow, pick, portions, row_key, whole_text, written

_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, from the golden ratio


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word; 0 is kept for places outside a document."""
    h = xxhash.xxh64_intdigest
    found = np.array([h(w) for w in words], dtype=np.uint64)
    found[found == 0] = 1
    return found


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` words from each place on."""
    n = len(words) - gram + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(gram):
        out = out * _MIX + words[k : k + len(out)]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def _slide(values: np.ndarray, size: int, combine: np.ufunc) -> np.ndarray:
    """``combine`` over each ``size`` consecutive values, by doubling."""
    span = 1
    while 2 * span <= size:
        values = combine(values[:-span], values[span:])
        span *= 2
    return combine(values[: len(values) - (size - span)], values[size - span :]) if size > span else values


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """A hash of the ``window`` words from each place on, from hashes of half as many, and so on."""

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (a ^ (a >> np.uint64(32))) * _MIX + b
        return x ^ (x >> np.uint64(29))

    return _slide(words, window, pair)


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A number per word, the same for equal words only."""
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy()


def repeats(hashes: np.ndarray, words: list[bytes], window: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the places whose window stands earlier too in the same text, and of those whose window stands twice or more there.

    ``hashes`` (equal for equal windows of one text) bring candidates together; words and ``owner``, the text's number, decide.
    """
    later, twice = np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=bool)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if same.any():
        a, b = order[:-1][same], order[1:][same]
        numbers = word_numbers(words)
        equal = owner[a] == owner[b]
        for k in range(window):
            equal &= numbers[a + k] == numbers[b + k]
        if not equal.all():  # different windows of one hash: the window itself is the key
            seen: dict[tuple[int, bytes], int] = {}  # by text and words
            a, b, equal = [], [], True
            for at in np.unique(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]).tolist():
                key = (int(owner[at]), numbers[at : at + window].tobytes())
                if key in seen:
                    a.append(seen[key])
                    b.append(at)
                seen[key] = at
            a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        later[b[equal]] = True
        twice[b[equal]] = True
        twice[a[equal]] = True
    return later, twice


def anchors(words: np.ndarray, ends: np.ndarray, plain: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors in several documents' words (``plain``, and by hash) one after another.

    ``ends`` has the end of its document for each word. A place is an anchor if its gram has
    the least hash of some window; all places with that hash count, so the choice depends on
    the window's words alone. Of equal windows of one document the first alone counts: the others
    are known to repeat without any other document.
    """
    width = window - gram + 1
    if len(words) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    grams = gram_hashes(words, gram)
    least = _slide(grams, width, np.minimum)  # of the window that starts here
    outside = np.arange(len(least)) + window > ends[: len(least)]  # no window of one document
    least[outside] = 0
    own = (ends[: len(least)].astype(np.uint64) * _MIX) ^ window_hashes(words, window)
    own[outside] = np.flatnonzero(outside).astype(np.uint64)  # meets nothing
    least[repeats(own, plain, window, ends)[0]] = 0
    pad = np.zeros(width - 1, dtype=np.uint64)
    cover = _slide(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero((cover == grams) & (cover != 0))
    return at, grams[at]


def _joined(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The words of several texts one after another; for each its text's number, start and end."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split])
    ends = np.cumsum(sizes)
    return [w for s in split for w in s], np.repeat(np.arange(len(texts)), sizes), np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)


def _keyed(df: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    named = {f"carry{i}": c for i, c in enumerate(carry)}
    rows = pick(df, id=id_col, text=text_col, **named).withColumn("text", whole_text(F.col("text")))
    k1, k2 = row_key(F.col("id"), F.col("text"))
    return rows.select("id", "text", k1.alias("k1"), k2.alias("k2"), *named)


def sampled_suffixes(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """``k1, k2, pos, h``: the anchors of every row."""

    def start():
        def step(batch: pa.RecordBatch):
            texts = as_bytes(batch, "text")
            k1, k2 = (column(batch, c).to_numpy() for c in ("k1", "k2"))
            for lo, hi in portions(texts, 256):
                words, text_of, first, ends = _joined(texts[lo:hi])
                at, h = anchors(word_hashes(words), ends, words, window, gram)
                owners = lo + text_of[at]
                yield pa.RecordBatch.from_arrays([pa.array(k1[owners]), pa.array(k2[owners]), pa.array((at - first[at]).astype(np.int32)), pa.array(h.view(np.int64))], names=["k1", "k2", "pos", "h"])

        return step

    return map_arrow(rows.select("k1", "k2", "text"), "k1 long, k2 long, pos int, h long", start)


def short_words(words: list[bytes], most: int = 128) -> list[bytes]:
    """Words with long ones replaced by a mark and their SHA-256; a word that begins with the mark is replaced too."""
    return [w if len(w) <= most and w[:1] != b"\x01" else b"\x01" + hashlib.sha256(w).hexdigest().encode() for w in words]


def contexts(words: list[bytes], places: list[int], left: int, window: int) -> list[bytes]:
    """Words from ``left`` before to ``window`` after each place of one document, with a space between; empty outside it."""
    padded = [b""] * left + short_words(words) + [b""] * window
    return [b" ".join(padded[p : p + left + window]) for p in places]


def context_numbers(ctx: pa.Array, width: int) -> np.ndarray:
    """A row of numbers for each context, equal for equal words only; 0 outside the document."""
    words = pc.split_pattern(ctx.cast(pa.string()), " ").flatten()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    coded = words.dictionary_encode()
    numbers = coded.indices.to_numpy() + 1
    outside = pc.index(coded.dictionary, "").as_py()
    if outside >= 0:
        numbers = np.where(numbers == outside + 1, 0, numbers)
    return numbers.astype(np.uint32).reshape(-1, width)


def candidate_suffixes(joined: DataFrame, window: int, gram: int) -> DataFrame:
    """``h, n, k1, k2, pos, ctx``: each repeated anchor with the words around it.

    ``joined`` has ``text`` and ``places``, an array of (pos, h, n).
    """
    left = window - gram
    names = ["h", "n", "k1", "k2", "pos", "ctx"]

    def start():
        def step(batch: pa.RecordBatch):
            k1, k2 = (column(batch, c).to_numpy() for c in ("k1", "k2"))
            texts, places = column(batch, "text"), column(batch, "places")
            held, rows = [], 0
            for i in range(batch.num_rows):
                at = places[i].values
                pos, h, n = (at.field(k) for k in (0, 1, 2))
                words = texts[i].as_py().encode().split()
                for lo in range(0, len(pos), 4096):
                    part = pos.slice(lo, 4096)
                    m = len(part)
                    ctx = pa.array(contexts(words, part.to_pylist(), left, window), pa.binary())
                    held.append(pa.RecordBatch.from_arrays([h.slice(lo, m), n.slice(lo, m), pa.array(np.full(m, k1[i])), pa.array(np.full(m, k2[i])), part, ctx], names=names))
                    rows += m
                    if rows >= 4096:
                        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        held, rows = [], 0
            if rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        return step

    return map_arrow(joined, "h long, n long, k1 long, k2 long, pos int, ctx binary", start)


def _depths(rows: np.ndarray) -> np.ndarray:
    """Common prefix length of each row with the one before it; 0 for the first."""
    same = rows[1:] == rows[:-1]
    depth = np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1))
    return np.concatenate([[0], depth])


class Subtree:
    """The suffix tree of a batch of groups, as sorted rows and the depths between neighbours.

    ``node(d)`` numbers the nodes of depth ``d``: rows have the same number if their first
    ``d`` words are the same.
    """

    def __init__(self, rows: np.ndarray):
        packed = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
        self.order = np.argsort(packed, kind="stable")
        self.depth = _depths(rows[self.order])

    def node(self, depth: int) -> np.ndarray:
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.cumsum(self.depth < depth)
        return out


def repeated_starts(h: np.ndarray, ctx: np.ndarray, window: int, gram: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Per suffix a bit for each o from its ``lo`` to ``hi``: the window that starts o words before the anchor repeats.

    ``h`` are whole groups, one row per occurrence.
    """
    left = window - gram
    group = np.cumsum(np.concatenate([[1], h[1:] != h[:-1]])).astype(np.uint32)[:, None]
    right = Subtree(np.concatenate([group, ctx[:, left:]], axis=1))
    back = Subtree(np.concatenate([group, ctx[:, :left][:, ::-1]], axis=1))
    outside_left = np.cumsum(ctx[:, :left][:, ::-1] == 0, axis=1) > 0
    outside_right = np.cumsum(ctx[:, left:] == 0, axis=1) > 0
    bits = np.zeros(len(h), dtype=np.int64)
    for o in range(int(lo.min()), int(hi.max()) + 1):
        sound = ~outside_right[:, window - o - 1] & (lo <= o) & (o <= hi)
        if o:
            sound &= ~outside_left[:, o - 1]
        pair = right.node(window - o + 1) * (len(h) + 1) + back.node(o + 1)
        pair[~sound] = -1 - np.flatnonzero(~sound)
        _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        bits |= ((count > 1)[which] & sound).astype(np.int64) << o
    return bits


def subtree_repeats(suffixes: DataFrame, window: int, gram: int, batch_rows: int = 8_000) -> DataFrame:
    """``k1, k2, pos, bits`` of the suffixes with a repeated window; groups (``h``) are whole in a partition and sorted."""
    width = 2 * window - gram

    def run(batches):
        lean()
        held: list[pa.RecordBatch] = []
        rows = 0

        def solve(parts: list[pa.RecordBatch]):
            table = pa.Table.from_batches(parts).combine_chunks()
            h, lo, hi = (table.column(c).to_numpy() for c in ("h", "lo", "hi"))
            ctx = context_numbers(table.column("ctx").chunk(0), width)
            bits = repeated_starts(h, ctx, window, gram, lo, hi)
            hit = pa.array(bits != 0)
            out = pa.table({"k1": table.column("k1"), "k2": table.column("k2"), "pos": table.column("pos"), "bits": pa.array(bits)}).filter(hit)
            yield from out.to_batches()

        for batch in batches:
            h = column(batch, "h").to_numpy()
            held.append(batch)
            rows += len(h)
            if rows >= batch_rows and len(h) and h[0] != h[-1]:
                cut = int(np.flatnonzero(h != h[-1])[-1]) + 1  # the last group may go on
                held[-1] = batch.slice(0, cut)
                yield from solve(held)
                held, rows = [batch.slice(cut)], len(h) - cut
        if rows:
            yield from solve(held)

    return suffixes.mapInArrow(run, "k1 long, k2 long, pos int, bits long")


def longer_prefixes(suffixes: DataFrame, window: int, gram: int, size: int) -> DataFrame:
    """Suffixes of large groups again, once for each range of at most ``size`` starts between ``lo`` and ``hi``: ``h, lo, hi, k1, k2, pos, ctx``.

    ``h`` is the hash of the range and of the words that its windows share; a suffix none of whose windows of
    a range lies in the document has no row for it.
    """
    left = window - gram
    names = ["h", "lo", "hi", "k1", "k2", "pos", "ctx"]

    def start():
        def step(batch: pa.RecordBatch):
            ctx = column(batch, "ctx").to_pylist()
            split = [c.split(b" ") for c in ctx]
            lo, hi = (column(batch, c).to_numpy() for c in ("lo", "hi"))
            at, out = [], []
            for i, words in enumerate(split):
                for x in range(int(lo[i]), int(hi[i]) + 1, size):
                    y = min(x + size - 1, int(hi[i]))
                    core = words[left - x : left + window - y]
                    if b"" not in core:
                        at.append(i)
                        out.append((xxhash.xxh64_intdigest(b"%d %d " % (x, y) + b" ".join(core)) - (1 << 63), x, y))
            if at:
                places = pa.array(at, pa.int64())
                h, x, y = zip(*out)
                rest = [column(batch, c).take(places) for c in ("k1", "k2", "pos", "ctx")]
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(x, pa.int32()), pa.array(y, pa.int32()), *rest], names=names)

        return step

    return map_arrow(suffixes.select("lo", "hi", "k1", "k2", "pos", "ctx"), "h long, lo int, hi int, k1 long, k2 long, pos int, ctx binary", start)


def leaves(suffixes: DataFrame, window: int, gram: int) -> DataFrame:
    """The windows over suffixes of large groups, each named by its start and the SHA-256 of its words: ``w, k1, k2, pos, bits``."""
    left = window - gram

    def start():
        def step(batch: pa.RecordBatch):
            lo, hi = (column(batch, c).to_numpy() for c in ("lo", "hi"))
            at, name, bits = [], [], []
            for i, c in enumerate(column(batch, "ctx").to_pylist()):
                words = c.split(b" ")
                for o in range(int(lo[i]), int(hi[i]) + 1):
                    part = words[left - o : left - o + window]
                    if b"" not in part:
                        at.append(i)
                        name.append(hashlib.sha256(b"%d " % o + b" ".join(part)).digest()[:16])
                        bits.append(1 << o)
            if at:
                places = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), *(column(batch, c).take(places) for c in ("k1", "k2", "pos")), pa.array(bits, pa.int64())], names=["w", "k1", "k2", "pos", "bits"])

        return step

    return map_arrow(suffixes.select("lo", "hi", "k1", "k2", "pos", "ctx"), "w binary, k1 long, k2 long, pos int, bits long", start)


def solved(suffixes: DataFrame, large: DataFrame | None, window: int, gram: int, group_limit: int, steps: tuple[int, ...]) -> DataFrame:
    """``k1, k2, pos, bits`` of all repeated windows; ``suffixes`` of groups that fit and of ``large`` ones have ``h, k1, k2, pos, ctx``."""

    def trees(groups: DataFrame) -> DataFrame:
        return subtree_repeats(groups.repartition("h").sortWithinPartitions("h"), window, gram)

    whole = {"lo": F.lit(0), "hi": F.lit(window - gram)}
    found = trees(suffixes.withColumns(whole))
    if large is None:
        return found
    large = large.withColumns(whole)
    for size in steps:
        longer = written(longer_prefixes(large, window, gram, size), "longer")
        counts = written(longer.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "counts")
        met = lookup(longer, counts, ["h"], "n", "k1")
        found = found.unionByName(trees(met.where(F.col("n") <= group_limit).drop("n")))
        large = met.where(F.col("n") > group_limit)
    named = written(leaves(large, window, gram), "leaves")
    counts = written(named.groupBy("w").agg(F.count("*").alias("m")).where("m > 1"), "counts")
    return found.unionByName(lookup(named, counts, ["w"], "m", "k1").select("k1", "k2", "pos", "bits"))


def _strip(joined: DataFrame, carry: list, window: int, gram: int) -> DataFrame:
    """``id, n_words, n_removed, kept`` and carried columns of rows with ``text`` and ``bits`` (array of (pos, bits))."""
    names = ["id", *[f.name for f in carry]]
    joined = joined.select(*names, "text", "bits")

    def start():
        def step(batch: pa.RecordBatch):
            texts, bits = as_bytes(batch, "text"), column(batch, "bits")
            total, gone, kept = [], [], []
            for i, text in enumerate(texts):
                words = text.split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                if len(words) > window:
                    at = np.flatnonzero(repeats(window_hashes(word_hashes(words), window), words, window, np.zeros(len(words)))[1])
                    edge[at] += 1
                    edge[at + window] -= 1
                if bits[i].is_valid:
                    pos, mask = (bits[i].values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                    for o in range(window - gram + 1):
                        at = pos[(mask >> o) & 1 == 1] - o
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + window, -1)
                covered = np.cumsum(edge[:-1]) > 0
                n = int(covered.sum())
                total.append(len(words))
                gone.append(n)
                kept.append(b" ".join([w for w, c in zip(words, covered.tolist()) if not c] if n else words))
            out = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), *out], names=[*names, "n_words", "n_removed", "kept"])

        return step

    schema = StructType([*joined.select(*names).schema.fields, *(StructField(c, LongType()) for c in ("n_words", "n_removed")), StructField("kept", StringType())])
    return map_arrow(joined, schema, start)


def strip_repeats(df: DataFrame, window: int = 35, gram: int = 16, group_limit: int = 50_000, steps: tuple[int, ...] = (10,), id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``id, n_words, n_removed, kept`` (the kept words, joined by a space) and the columns named in ``carry``, as ``carry0`` and so on."""
    if not 1 <= gram <= window or window - gram > 62:
        raise ValueError("a gram is at most a window, and a window at most 62 words longer")
    rows = _keyed(df, id_col, text_col, carry or [])
    sampled = written(sampled_suffixes(rows, window, gram), "suffixes")
    repeated = written(sampled.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "prefixes")
    places = (
        lookup(sampled, repeated, ["h"], "n", "k1")
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("pos", "h", "n")).alias("places"))  # equal rows give the same places once
    )
    places = written(places, "places")

    def around(which: str) -> DataFrame:
        some = places.withColumn("places", F.filter("places", lambda p: (p["n"] > group_limit) == (which == "large")))
        return candidate_suffixes(rows.join(some.where(F.size("places") > 0), ["k1", "k2"]), window, gram).drop("n")

    large = None if repeated.where(F.col("n") > group_limit).isEmpty() else around("large")
    discard(sampled, repeated)
    found = solved(around("small"), large, window, gram, group_limit, steps).groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "bits")).alias("bits"))
    joined = rows.join(found, ["k1", "k2"], "left")
    return _strip(joined, [f for f in rows.schema.fields if f.name.startswith("carry")], window, gram)

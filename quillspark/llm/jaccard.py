"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word shingles. The join finds every pair of different texts whose sets have a
Jaccard similarity of at least ``threshold``:

1. Signatures. Each text has MinHash values; bands of them are bucket keys. With 32 bands of 4 a pair
   at 0.8 shares no bucket with probability 5e-8. Equal texts become one row first.
2. Pruning. In a bucket, signatures are compared in steps. After each step the posterior
   probability (uniform prior) that a pair reaches the threshold is looked up by the number of equal values; below
   ``tolerance`` the pair is dropped. A bucket's surviving pairs are not listed: a breadth-first
   walk emits the edges of a spanning forest, at most one per member. A bucket of more than ``crowd`` members is no
   single group: all members meet its head (the least of them) in as many tasks as needed, and only those that the
   pruning parts from the head meet all others, in tiles of ``crowd`` by ``crowd``.
3. Verification. Components of that forest hold all surviving pairs. Within a component the
   shingle sets are multiplied block by block, which gives the exact intersection of every pair; links are counted per
   text, and again only a spanning forest of exact links leaves the block. Large
   components are split into blocks of ``block`` texts and 1000 times as many shingles; every
   pair of blocks is dealt out on its own.
4. Classes are the components of the exact links.

So no pair is lost beyond the stated tolerance, and no table lists pairs. Counting the links of a component of n different
texts is n * n / 2 intersections, and each text is sent to n / ``block`` pairs of blocks: of these
copies there are n * n / ``block``.

Defined cases: null text is the empty text; a text of fewer words than a shingle is one shingle
of all its words; texts without words are linked to nothing but equal texts; equal rows share
a class; a class's id is its least document id, null ids aside; a very long text takes memory in
proportion to its shingles; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, column, discard, lookup, map_arrow, pick, portions, text_key, whole_text, written
from .components import components

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``k`` words."""
    h = xxhash.xxh64_intdigest
    words = np.array([h(w) for w in text.split()], dtype=np.uint64)
    if not len(words):
        return words
    n = max(len(words) - k + 1, 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(k, len(words))):
        out = out * _MIX + words[i : i + n]
    return np.unique(_finish(out))


class MinHash:
    """``bands * rows`` hash functions; the same for every run."""

    def __init__(self, bands: int, rows: int):
        make = np.random.Generator(np.random.PCG64(20240229))
        self.bands, self.rows = bands, rows
        self.a = make.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = make.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def __call__(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Band keys and one-byte signatures of non-empty sets."""
        sizes = np.array([len(s) for s in sets])
        firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        joined = np.concatenate(sets)
        least = np.empty((len(sets), self.bands * self.rows), dtype=np.uint64)
        for i, (a, b) in enumerate(zip(self.a, self.b)):
            least[:, i] = np.minimum.reduceat((joined * a + b) >> np.uint64(16), firsts)
        keys = np.zeros((len(sets), self.bands), dtype=np.uint64)
        by_band = least.reshape(len(sets), self.bands, self.rows)
        for j in range(self.rows):
            keys = _finish(keys * _MIX + by_band[:, :, j])
        keys = _finish(keys + np.arange(self.bands, dtype=np.uint64) * _MIX)
        return keys, (least & np.uint64(0xFF)).astype(np.uint8)


def pruning_limits(length: int, step: int, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, least number of equal values that is not dropped) after each step.

    One-byte values of different shingles agree by chance with probability 1/256; the prior of
    the similarity is uniform.
    """
    grid = (np.arange(4000) + 0.5) / 4000
    agree = grid + (1 - grid) / 256
    out = []
    for n in range(step, length + 1, step):
        least = n + 1
        for m in range(n, -1, -1):
            log = lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(agree) + (n - m) * np.log1p(-agree)
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() / weight.sum() < tolerance:
                break
            least = m
        out.append((n, least))
    return out


def surviving_forest(signatures: np.ndarray, limits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs that pruning leaves. Each member is expanded once."""
    left = np.arange(len(signatures))
    edges: list[tuple[int, int]] = []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop()
        if not len(left):
            break
        near, start = left, 0
        equal = np.zeros(len(left), dtype=np.int64)
        for n, least in limits:
            equal = equal + (signatures[near, start:n] == signatures[at, start:n]).sum(axis=1)
            alive = equal >= least
            near, equal, start = near[alive], equal[alive], n
            if not len(near):
                break
        if len(near):
            edges += [(at, int(x)) for x in near]
            queue += near.tolist()
            left = left[~np.isin(left, near, assume_unique=True)]
    return edges


def link_matrix(rows: list[np.ndarray], cols: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Whether the Jaccard similarity is >= threshold, of ``rows`` with ``cols``, or of each two of ``rows`` (false for one with itself)."""
    sets = rows + (cols or [])
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes.astype(np.int64))
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    which = np.cumsum(new) - 1
    # A shingle of one text adds nothing to any intersection.
    shared = np.bincount(which)[which] > 1
    which, owner = which[shared], owner[shared]
    r, c = len(rows), len(rows) if cols is None else len(cols)
    both = np.zeros((r, c), dtype=np.float32)
    if len(which):
        which = np.cumsum(np.concatenate([[True], which[1:] != which[:-1]])) - 1  # still by shingle
        n = int(which[-1]) + 1
        for lo in range(0, n, 512):  # columns in slices keep the matrices small
            a, b = np.searchsorted(which, (lo, lo + 512))
            matrix = np.zeros((len(sets), min(512, n - lo)), dtype=np.float32)
            matrix[owner[a:b], which[a:b] - lo] = 1
            both += matrix[:r] @ (matrix[r:] if cols is not None else matrix).T
    right = sizes[r:] if cols is not None else sizes
    out = np.zeros((r, c), dtype=bool)
    for lo in range(0, r, 256):
        part = both[lo : lo + 256].astype(np.float64)
        # both / union >= threshold without the rounding of a quotient
        out[lo : lo + 256] = part >= threshold * (sizes[lo : lo + len(part), None] + right[None, :] - part) - 1e-9
    if cols is None:
        np.fill_diagonal(out, False)
    return out


def exact_links(rows: list[np.ndarray], cols: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with Jaccard similarity >= threshold, of ``rows`` with ``cols``, or among ``rows`` (i < j)."""
    i, j = np.nonzero(link_matrix(rows, cols, threshold))
    return (i, j) if cols is not None else (i[i < j], j[i < j])


def matrix_forest(links: np.ndarray, square: bool) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a link matrix. Nodes are its rows, and its columns after them unless it is ``square``."""
    r, c = links.shape
    edges: list[tuple[int, int]] = []
    if square:
        left = np.ones(r, dtype=bool)
        for seed in range(r):
            queue = [seed] if left[seed] else []
            left[seed] = False
            while queue:
                at = queue.pop()
                near = np.flatnonzero(links[at] & left)
                left[near] = False
                edges += [(at, int(x)) for x in near]
                queue += near.tolist()
        return edges
    rows_left, cols_left, across = np.ones(r, dtype=bool), np.ones(c, dtype=bool), np.ascontiguousarray(links.T)
    for seed in range(r):
        queue = [seed] if rows_left[seed] else []
        rows_left[seed] = False
        while queue:
            at = queue.pop()
            if at < r:
                near = np.flatnonzero(links[at] & cols_left)
                cols_left[near] = False
                near = near + r
            else:
                near = np.flatnonzero(across[at - r] & rows_left)
                rows_left[near] = False
            edges += [(at, int(x)) for x in near]
            queue += near.tolist()
    return edges


def _signatures(rows: DataFrame, k: int, bands: int, band_rows: int) -> DataFrame:
    schema = f"id {rows.schema['id'].dataType.simpleString()}, t1 long, t2 long, n long, bands array<long>, sig binary"

    def start():
        family = MinHash(bands, band_rows)

        def step(batch: pa.RecordBatch):
            texts = as_bytes(batch, "text")
            for lo, hi in portions(texts, 128):
                sets = [shingle_set(t, k) for t in texts[lo:hi]]
                some = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [[] for _ in sets]
                sigs: list = [b"" for _ in sets]
                if some:
                    found, short = family([sets[i] for i in some])
                    for i, row, sig in zip(some, found.view(np.int64), short):
                        keys[i], sigs[i] = row, sig.tobytes()
                part = [column(batch, c).slice(lo, hi - lo) for c in ("id", "t1", "t2")]
                yield pa.RecordBatch.from_arrays([*part, pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["id", "t1", "t2", "n", "bands", "sig"])

        return step

    return map_arrow(rows, schema, start)


def _groups(batches, keys: list[str]):
    """Whole groups (tables) of batches that are sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [column(batch, k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and any(c[0] != v for c, v in zip(cols, last))
        last = [c[-1] for c in cols]
        begin = 0
        for cut in np.flatnonzero(change):
            if cut > begin:
                held.append(batch.slice(begin, cut - begin))
            yield held
            held, begin = [], int(cut)
        held.append(batch.slice(begin))
    if held:
        yield held


def _joined(parts: list[pa.RecordBatch], name: str) -> list:
    return [x for p in parts for x in column(p, name).to_pylist()]


def candidate_edges(members: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """``a, b``: a spanning forest of each bucket's surviving pairs; ``members`` has ``bucket, tid, sig`` by bucket."""

    def run(batches):
        a: list[int] = []
        b: list[int] = []
        for parts in _groups(batches, ["bucket"]):
            if sum(p.num_rows for p in parts) < 2:
                continue
            ids = _joined(parts, "tid")
            sigs = np.frombuffer(b"".join(_joined(parts, "sig")), dtype=np.uint8).reshape(len(ids), -1)
            for i, j in surviving_forest(sigs, limits):
                a.append(ids[i])
                b.append(ids[j])
            if len(a) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def alive(mine: np.ndarray, other: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """For each two rows of signatures whether pruning leaves the pair."""
    keep, equal, start = np.arange(len(mine)), np.zeros(len(mine), dtype=np.int64), 0
    for n, least in limits:
        equal = equal + (mine[keep, start:n] == other[keep, start:n]).sum(axis=1)
        good = equal >= least
        keep, equal, start = keep[good], equal[good], n
    out = np.zeros(len(mine), dtype=bool)
    out[keep] = True
    return out


def crowded_edges(members: DataFrame, limits: list[tuple[int, int]], crowd: int) -> DataFrame:
    """``a, b``: edges that connect what survives in buckets of any size; ``members`` has ``bucket, m, tid, sig``, ``m`` the bucket's size."""
    heads = members.groupBy("bucket", "m").agg(F.min("tid").alias("head"), F.min_by("sig", "tid").alias("head_sig"))

    def start():
        def step(batch: pa.RecordBatch):
            sig, head = (np.frombuffer(b"".join(column(batch, c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("sig", "head_sig"))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("bucket", "m", "tid", "sig", "head")), pa.array(alive(sig, head, limits))], names=["bucket", "m", "tid", "sig", "head", "near"])

        return step

    met = lookup(members.drop("m"), heads, ["bucket"], "m", "tid")
    met = written(map_arrow(met.select("bucket", "m", "tid", "sig", "head", "head_sig"), "bucket long, m long, tid long, sig binary, head long, near boolean", start), "crowds")
    edges = met.where("near and tid <> head").select(F.col("head").alias("a"), F.col("tid").alias("b"))
    far = met.where("not near")
    sizes = far.groupBy("bucket", "m").agg(F.count("*").alias("f"))
    if sizes.isEmpty():
        return edges
    tiles = sizes.select("bucket", F.ceil(F.col("m") / crowd).alias("nj"), F.ceil(F.col("f") / crowd).alias("ni"), "m")
    place = lambda n: F.pmod(F.xxhash64("tid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    strangers = lookup(far.select("bucket", "tid", "sig"), tiles, ["bucket"], "m", "tid").select("bucket", place("ni").alias("i"), every("nj").alias("j"), F.lit(True).alias("far"), "tid", "sig")
    others = lookup(met.select("bucket", "tid", "sig"), tiles, ["bucket"], "m", "tid").select("bucket", every("ni").alias("i"), place("nj").alias("j"), F.lit(False).alias("far"), "tid", "sig")

    def run(batches):
        for parts in _groups(batches, ["bucket", "i", "j"]):
            ids, is_far = np.array(_joined(parts, "tid"), dtype=np.int64), np.array(_joined(parts, "far"))
            sigs = np.frombuffer(b"".join(_joined(parts, "sig")), dtype=np.uint8).reshape(len(ids), -1)
            rows, cols = np.flatnonzero(is_far), np.flatnonzero(~is_far)
            if not len(rows) or not len(cols):
                continue
            links = np.stack([alive(np.broadcast_to(sigs[x], (len(cols), sigs.shape[1])), sigs[cols], limits) & (ids[cols] != ids[x]) for x in rows])
            found = matrix_forest(links, False)
            name = np.concatenate([ids[rows], ids[cols]])
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(name[a]), pa.array(name[b])], names=["a", "b"])

    dealt = strangers.unionByName(others).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return edges.unionByName(dealt.mapInArrow(run, "a long, b long"))


def _sets(rows: DataFrame, k: int) -> DataFrame:
    def start():
        def step(batch: pa.RecordBatch):
            texts = as_bytes(batch, "text")
            for lo, hi in portions(texts, 512):
                found = pa.array([shingle_set(t, k).tobytes() for t in texts[lo:hi]], pa.binary())
                yield pa.RecordBatch.from_arrays([*(column(batch, c).slice(lo, hi - lo) for c in ("tid", "root", "n_blocks")), found], names=["tid", "root", "n_blocks", "shingles"])

        return step

    return map_arrow(rows, "tid long, root long, n_blocks long, shingles binary", start)


def verified(blocks: DataFrame, threshold: float) -> DataFrame:
    """``a, b, n``: per text ``a`` its number of links in a pair of blocks (``b`` null), and forest edges (``n`` 0).

    ``blocks`` has ``root, i, j, mine, tid, shingles`` by (root, i, j); in a pair of different
    blocks a text of block ``mine`` meets those of the other one only.
    """

    def run(batches):
        out: list[tuple] = []
        for parts in _groups(batches, ["root", "i", "j"]):
            ids = np.array(_joined(parts, "tid"), dtype=np.int64)
            if len(ids) < 2:
                continue
            mine, i0, j0 = np.array(_joined(parts, "mine")), column(parts[0], "i")[0].as_py(), column(parts[0], "j")[0].as_py()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in _joined(parts, "shingles")]
            rows, cols = (np.arange(len(ids)), None) if i0 == j0 else (np.flatnonzero(mine == i0), np.flatnonzero(mine == j0))
            if not len(rows) or cols is not None and not len(cols):
                continue
            matrix = link_matrix([sets[x] for x in rows], None if cols is None else [sets[x] for x in cols], threshold)
            name = ids[rows] if cols is None else ids[np.concatenate([rows, cols])]
            links = matrix.sum(axis=1) if cols is None else np.concatenate([matrix.sum(axis=1), matrix.sum(axis=0)])
            out += [(int(name[x]), None, int(links[x])) for x in np.flatnonzero(links)]
            out += [(int(name[a]), int(name[b]), 0) for a, b in matrix_forest(matrix, cols is None)]
            if len(out) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "n"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "n"])

    return blocks.mapInArrow(run, "a long, b long, n long")


def join(df: DataFrame, k: int = 5, threshold: float = 0.8, bands: int = 32, band_rows: int = 4, step: int = 32, tolerance: float = 1e-6, block: int = 2000, crowd: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, class_id, n_links, n_copies, t1, t2, root`` of every row.

    ``n_links`` counts the other *different* texts that the text is linked to, ``n_copies`` the
    rows with the same text, the row itself among them. ``t1, t2`` identify the text, ``root`` the class.
    """
    rows = pick(df, id=id_col, text=text_col).withColumn("text", whole_text(F.col("text")))
    t1, t2 = text_key(F.col("text"))
    rows = rows.withColumns({"t1": t1, "t2": t2})
    signed = written(_signatures(rows, k, bands, band_rows), "signatures")
    texts = signed.groupBy("t1", "t2").agg(F.min("id").alias("least_id"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    texts = written(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")
    buckets = texts.select("tid", F.explode("bands").alias("bucket"))
    shared = written(buckets.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    limits = pruning_limits(bands * band_rows, step, threshold, tolerance)

    def members(sizes: DataFrame) -> DataFrame:
        return lookup(buckets, sizes, ["bucket"], "m", "tid").join(texts.select("tid", "sig"), "tid").select("bucket", "m", "tid", "sig")

    few = members(shared.where(F.col("m") <= crowd)).select("bucket", "tid", "sig")
    forest_edges = candidate_edges(few.repartition("bucket").sortWithinPartitions("bucket"), limits)
    many = shared.where(F.col("m") > crowd)
    if not many.isEmpty():
        forest_edges = forest_edges.unionByName(crowded_edges(written(members(many), "members"), limits, crowd))
    near = written(components(forest_edges), "near")
    placed = near.join(texts.select("t1", "t2", "tid", "n"), near["node"] == F.col("tid"))
    sizes = written(placed.groupBy("root").agg(F.count("*").alias("m"), F.ceil(F.greatest(F.count("*") / block, F.sum("n") / (1000 * block))).alias("n_blocks")), "sizes")
    wanted = lookup(placed, sizes, ["root"], "m", "tid").select("t1", "t2", "tid", "root", "n_blocks")
    # One text of each group of copies is enough; copies fall together before the shuffle.
    once = rows.groupBy("t1", "t2").agg(F.first("text").alias("text"))
    sets = _sets(once.join(wanted, ["t1", "t2"]).select("tid", "root", "n_blocks", "text"), k)
    mine = F.pmod(F.xxhash64("tid"), F.col("n_blocks"))
    dealt = sets.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    dealt = dealt.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "tid", "shingles")
    found = written(verified(dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j"), threshold), "links")
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n_links"))
    classes = components(found.where("b is not null").select("a", "b"))
    named = (
        texts.select("t1", "t2", "tid", "least_id", "n_copies")
        .join(links, F.col("tid") == F.col("a"), "left")
        .drop("a")
        .join(classes, F.col("tid") == F.col("node"), "left")
        .withColumn("root", F.coalesce("root", "tid"))
    )
    named = written(named.select("t1", "t2", "root", "least_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classes")
    discard(texts, shared, near, sizes, found)
    ids = written(named.groupBy("root").agg(F.min("least_id").alias("class_id"), F.count("*").alias("m")), "ids")
    labelled = written(lookup(named, ids, ["root"], "m", "t1").select("t1", "t2", "root", "class_id", "n_links", "n_copies"), "labelled")
    discard(named, ids)
    return lookup(signed.select("id", "t1", "t2"), labelled, ["t1", "t2"], "n_copies", "id").select("id", "class_id", "n_links", "n_copies", "t1", "t2", "root")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stand for their class, with all their columns: one row of each class.

    It is a row with the class's id; of several, one with the least text key.
    """
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at_id, at_text = (f"c{df.columns.index(c)}" for c in (id_col, text_col))
    t1, t2 = text_key(whole_text(F.col(at_text)))
    classes = join(df, id_col=id_col, text_col=text_col, **options)
    heads = classes.where(F.col("id").eqNullSafe(F.col("class_id")))
    stays = heads.groupBy("root").agg(F.min(F.struct("t1", "t2")).alias("t"), F.first("class_id").alias("id")).select("id", "t.t1", "t.t2")
    stays = stays.withColumnsRenamed({"t1": "s1", "t2": "s2"})
    # The id is part of the key, so copies of one text don't meet in one task.
    kept = flat.withColumns({"t1": t1, "t2": t2}).join(stays, F.col(at_id).eqNullSafe(F.col("id")) & (F.col("t1") == F.col("s1")) & (F.col("t2") == F.col("s2")))
    first = F.row_number().over(Window.partitionBy("t1", "t2").orderBy("t1"))
    return kept.withColumn("nth", first).where("nth = 1").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])

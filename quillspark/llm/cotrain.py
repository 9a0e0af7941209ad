"""Quality classification by co-training.

Two views of a document each have a logistic model: its text content (hashed words with their
endings) and its page metadata (language, source and layout figures). Both start from
a bounded sample of labelled rows. In each round every unlabelled document is scored by both models in the executors; a
view that is sure of a document by its calibrated probability (``sure`` or more for either kind) labels it for
the *other* view. All such pseudo-labels count, however many there are: they enter the other view's next
fit as the sums of their gradients and of a bound of their curvatures, one number of each for each weight
and kind, which is all that leaves the executors. One part of the labelled sample calibrates each view,
another fits the weights of their sum; the result scores every document.

Features are written once, about half the size of the text; rounds and scores read them.
Sums are of whole numbers (fixed point), so neither partitions nor their order change a weight. The sample is
taken by the least hashes of the document id, one row an id: at most ``sample`` rows go to the driver.

Defined cases: null text is the empty text; null or unknown language, source and length (also one
that is no number) are feature values of their own; labels that are null or contradict each other are left out;
of rows with one labelled id the one with the least features is the sample's, ties of the hash go by id; all are scored;
without labels of both kinds in every part every document has the score of the prior (1 if there is none) and
is kept; repeated rows are scored each and count each as pseudo-labels; a very long text has as many features as
any other can have; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column, discard, lean, map_arrow, pick, portions, whole_text, written

TEXT_BITS, META_BITS = 14, 8
TEXT_SIZE, FIGURES = 1 << TEXT_BITS, 12
META_SIZE = (1 << META_BITS) + FIGURES
VIEWS = ("text", "meta")
#: Pseudo-labels' sums are whole multiples of 1 / FIXED.
FIXED = float(1 << 20)
_WEIGHT = 1 + np.log(np.maximum(np.arange(256), 1))


class WordBuckets(dict):
    """word -> its place in a table of three buckets a word: the word, its ending, its beginning, the latter two with its shape."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit, self.rows = limit, array("H")

    def __missing__(self, word: bytes) -> int:
        mask = TEXT_SIZE - 1
        shape = b"A" if word.isupper() else b"T" if word[:1].isupper() else b"a"
        self.rows.extend(xxhash.xxh32_intdigest(x) & mask for x in (b"w" + word.lower(), b"e" + shape + word[-2:], b"s" + shape + word[:2].lower()))
        at = len(self.rows) // 3 - 1
        if len(word) <= 64:
            self[word] = at
        return at

    def room(self) -> None:
        if len(self.rows) >= 3 * self.limit:
            self.clear()
            del self.rows[:]


class Batch:
    """Features of some documents: ``index, count`` of text buckets by document (``lengths``), hashed metadata, figures."""

    def __init__(self, index: np.ndarray, count: np.ndarray, lengths: np.ndarray, hashed: np.ndarray, figures: np.ndarray):
        self.size, self.index, self.count, self.lengths, self.hashed, self.figures = len(lengths), index, count, lengths, hashed, figures
        self.owner = np.repeat(np.arange(self.size), lengths)
        value = _WEIGHT[count]
        norm = np.sqrt(np.bincount(self.owner, value**2, self.size))
        self.value = value / norm[self.owner]

    @classmethod
    def of_columns(cls, ti: Iterable[bytes], tc: Iterable[bytes], meta: Iterable[bytes]) -> "Batch":
        tc = list(tc)
        packed = np.frombuffer(b"".join(meta), dtype=[("h", "<u2", 2), ("f", "<f4", FIGURES)])
        return cls(np.frombuffer(b"".join(ti), dtype="<u2"), np.frombuffer(b"".join(tc), dtype=np.uint8), np.array([len(c) for c in tc], dtype=np.int64), packed["h"], packed["f"])

    def margin(self, view: str, w: np.ndarray, b: float) -> np.ndarray:
        if view == "text":
            return np.bincount(self.owner, self.value * w[self.index], self.size) + b
        return 0.5 * w[self.hashed].sum(axis=1) + self.figures.astype(np.float64) @ w[1 << META_BITS :] + b

    def sums(self, view: str, error: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By weight, and for the offset at the end: the gradients ``error * x`` of the chosen documents, and a bound of their
        curvatures, ``|x_i| * sum(|x|) / 4``, both in units of 1 / FIXED."""
        whole = lambda x: np.rint(x * FIXED)
        if view == "text":
            at = np.flatnonzero(chosen[self.owner])
            owner, index, value = self.owner[at], self.index[at], self.value[at]
            total = np.bincount(self.owner, self.value, self.size) + 1
            size = TEXT_SIZE
        else:
            rows = np.flatnonzero(chosen)
            owner = np.repeat(rows, 2 + FIGURES)
            figures = np.broadcast_to(np.arange(1 << META_BITS, META_SIZE), (len(rows), FIGURES))
            index = np.concatenate([self.hashed[rows], figures], axis=1).ravel()
            value = np.concatenate([np.full((len(rows), 2), 0.5), self.figures[rows]], axis=1).astype(np.float64).ravel()
            total = np.abs(self.figures).sum(axis=1, dtype=np.float64) + 2
            size = META_SIZE
        g = np.append(np.bincount(index, whole(error[owner] * value), size), whole(error[chosen]).sum())
        h = np.append(np.bincount(index, whole(np.abs(value) * total[owner] / 4), size), whole(total[chosen] / 4).sum())
        return g, h


def _figures(chars: int | None, text: bytes, words: list[bytes]) -> list[float]:
    """Figures of the page's size and layout."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    n = max(len(text), 1)
    share = lambda signs: (len(text) - len(text.translate(None, signs))) / n
    return [
        math.log1p(chars if chars is not None and chars >= 0 else 0) / 10,
        math.log1p(len(lines)) / 5,
        math.log1p(len(text) / max(len(lines), 1)) / 10,
        4 * share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        8 * share(b"#*$%&|<>{}[]^~!@_=+\\"),
        8 * share(b".,;:?"),
        8 * share(b"0123456789"),
        1 - len(set(lines)) / max(len(lines), 1),
        len(set(words)) / max(len(words), 1),
        sum(map(bytes.__eq__, words, words[1:])) / max(len(words), 1),
        float(len(words) < 50),
        float(chars is None),
    ]


class Extractor:
    """Features of texts and their metadata, a portion at a time."""

    def __init__(self):
        self.buckets, self.hashes = WordBuckets(), {}

    def _hash(self, name: str, value: str | None) -> int:
        if len(self.hashes) > 50_000:
            self.hashes.clear()
        if (name, value) not in self.hashes:
            self.hashes[name, value] = xxhash.xxh32_intdigest(f"{name}={value}") % (1 << META_BITS)
        return self.hashes[name, value]

    def __call__(self, langs: list, sources: list, chars: list, texts: list[bytes]) -> tuple[list[bytes], list[bytes], list[bytes]]:
        self.buckets.room()
        split = [t.split() for t in texts]
        places = [np.fromiter(map(self.buckets.__getitem__, w), dtype=np.int64, count=len(w)) for w in split]
        table = np.array(self.buckets.rows, dtype=np.uint16).reshape(-1, 3)
        ti, tc, meta = [], [], []
        for lang, source, n, text, words, at in zip(langs, sources, chars, texts, split, places):
            counts = np.bincount(table[at].ravel(), minlength=1)
            index = np.flatnonzero(counts)
            ti.append(index.astype("<u2").tobytes())
            tc.append(np.minimum(counts[index], 255).astype(np.uint8).tobytes())
            hashed = np.array([self._hash("lang", lang), self._hash("source", source)], dtype="<u2")
            meta.append(hashed.tobytes() + np.array(_figures(n, text, words), dtype="<f4").tobytes())
        return ti, tc, meta


class Logistic:
    """Ridge logistic regression on sparse labelled rows, both kinds alike in weight, by Adam; further labels enter as sums.

    A fit goes on from the weights of the one before; the first is from zero weights. So it is the same on every run.
    """

    def __init__(self, view: str, ridge: float = 1e-5):
        self.view, self.ridge = view, ridge
        self.size = TEXT_SIZE if view == "text" else META_SIZE
        self.w, self.b = np.zeros(self.size), 0.0

    def fit(self, batch: Batch, y: np.ndarray, sums: dict[int, tuple[int, np.ndarray, np.ndarray]], steps: int, rate: float = 0.2) -> None:
        """``sums``: by kind the number of pseudo-labels and their ``Batch.sums`` at the present weights; both kinds or none count."""
        if self.view == "text":
            at, index, value = batch.owner, batch.index.astype(np.int64), batch.value
        else:
            at = np.repeat(np.arange(batch.size), 2 + FIGURES)
            index = np.concatenate([batch.hashed, np.broadcast_to(np.arange(1 << META_BITS, META_SIZE), (batch.size, FIGURES))], axis=1).astype(np.int64).ravel()
            value = np.concatenate([np.full((batch.size, 2), 0.5), batch.figures], axis=1).astype(np.float64).ravel()
        share = y.mean()
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
        linear, curved = np.zeros(self.size + 1), np.zeros(self.size + 1)
        if len(sums) == 2:
            for n, g, h in sums.values():
                linear += 0.5 * g / FIXED / n
                curved += 0.5 * h / FIXED / n
        first = np.append(self.w, self.b)
        now = first.copy()
        m, v, grad = (np.zeros(self.size + 1) for _ in range(3))
        for step in range(1, steps + 1):
            error = (_sigmoid(np.bincount(at, value * now[index], batch.size) + now[-1]) - y) * weight
            grad[:-1] = np.bincount(index, value * error[at], self.size) + self.ridge * now[:-1]
            grad[-1] = error.sum()
            grad += linear + curved * (now - first)
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            now -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        self.w, self.b = now[:-1], float(now[-1])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights of the columns of ``margin`` and an offset (Newton's method, smoothed targets)."""
    x = np.column_stack([margin, np.ones(len(y))])
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - target) + 1e-3 * w
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), grad)
        w -= move
        if abs(move).max() < 1e-9:
            break
    return w


class CoTrained:
    """Both views' models, their calibrations and the weights of the sum."""

    def __init__(self, prior: float):
        self.prior, self.models, self.own, self.both = prior, None, {}, None

    def logits(self, batch: Batch) -> dict[str, np.ndarray]:
        """Both views' calibrated log-odds."""
        return {v: batch.margin(v, m.w, m.b) * self.own[v][0] + self.own[v][1] for v, m in self.models.items()}

    def scores(self, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.both is None:
            return (np.full(batch.size, self.prior),) * 3
        own = self.logits(batch)
        joint = own["text"] * self.both[0] + own["meta"] * self.both[1] + self.both[2]
        return _sigmoid(own["text"]), _sigmoid(own["meta"]), _sigmoid(joint)


def _parts(y: np.ndarray) -> list[np.ndarray] | None:
    """Places of the training, the calibrating and the weighing labels (6, 1 and 1 of 8); None if a part lacks a kind."""
    at = np.arange(len(y)) % 8
    parts = [np.flatnonzero((at != 0) & (at != 4)), np.flatnonzero(at == 0), np.flatnonzero(at == 4)]
    return parts if all(len(set(y[p])) == 2 for p in parts) else None


def _inputs(flat: DataFrame, lang: str, source: str, chars: str) -> dict[str, Column]:
    return {"lang": F.col(lang).cast("string"), "source": F.col(source).cast("string"), "chars": F.expr(f"try_cast(`{chars}` as bigint)")}


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """``id, ti, tc, meta``: both views' sparse features of every document."""
    rows = pick(df, id=id_col, text=text_col, lang=lang_col, source=source_col, chars=chars_col)
    rows = rows.select("id", whole_text(F.col("text")).alias("text"), *[c.alias(n) for n, c in _inputs(rows, "lang", "source", "chars").items()])

    def start():
        extract = Extractor()

        def step(batch: pa.RecordBatch):
            texts, rest = as_bytes(batch, "text"), [column(batch, c).to_pylist() for c in ("lang", "source", "chars")]
            for lo, hi in portions(texts, 512, 1 << 20):
                found = extract(*(x[lo:hi] for x in rest), texts[lo:hi])
                yield pa.RecordBatch.from_arrays([column(batch, "id").slice(lo, hi - lo), *(pa.array(c, pa.binary()) for c in found)], names=["id", "ti", "tc", "meta"])

        return step

    return map_arrow(rows, f"id {rows.schema['id'].dataType.simpleString()}, ti binary, tc binary, meta binary", start)


def _slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[Batch]:
    """Features a few documents at a time: the working arrays are many times as large as the features."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield Batch.of_columns(*(column(batch.slice(lo, rows), c).to_pylist() for c in ("ti", "tc", "meta")))


def pseudo_sums(free: DataFrame, model: CoTrained, sure: float) -> dict[str, dict[int, tuple[int, np.ndarray, np.ndarray]]]:
    """For each view and kind what the *other* view is sure of: the number of documents and their ``Batch.sums``.

    Every row of ``free`` is scored; a task gives its sums by weight, and these are added up before they come to the driver:
    four rows for each weight at most, whatever the number of rows.
    """
    shared = free.sparkSession.sparkContext.broadcast(model)
    edge = math.log(sure / (1 - sure))

    def run(batches):
        lean()
        fitted = shared.value
        kept: dict[tuple[str, int], list] = {}
        for part in _slices(batches):
            logit = fitted.logits(part)
            for view, other in (("text", "meta"), ("meta", "text")):
                for kind in (0, 1):
                    chosen = logit[other] >= edge if kind else logit[other] <= -edge
                    if chosen.any():
                        m = fitted.models[view]
                        g, h = part.sums(view, _sigmoid(part.margin(view, m.w, m.b)) - kind, chosen)
                        held = kept.setdefault((view, kind), [0, 0.0, 0.0])
                        held[0], held[1], held[2] = held[0] + int(chosen.sum()), held[1] + g, held[2] + h
        for (view, kind), (n, g, h) in kept.items():
            at = np.flatnonzero((g != 0) | (h != 0))
            cols = [pa.array([view] * len(at)), pa.array(np.full(len(at), kind, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(g[at].astype(np.int64)), pa.array(h[at].astype(np.int64)), pa.array(np.where(at == len(g) - 1, n, 0))]
            yield pa.RecordBatch.from_arrays(cols, names=["view", "kind", "at", "g", "h", "n"])

    added = free.select("ti", "tc", "meta").mapInArrow(run, "view string, kind int, at int, g long, h long, n long").groupBy("view", "kind", "at").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
    out: dict[str, dict[int, tuple]] = {v: {} for v in VIEWS}
    size = {"text": TEXT_SIZE + 1, "meta": META_SIZE + 1}
    for r in added.collect():
        n, g, h = out[r["view"]].setdefault(r["kind"], (0, np.zeros(size[r["view"]]), np.zeros(size[r["view"]])))
        g[r["at"]], h[r["at"]] = r["g"], r["h"]
        out[r["view"]][r["kind"]] = (n + r["n"], g, h)
    return out


def fit(feats: DataFrame, labels: DataFrame, sample: int = 4000, rounds: int = 3, sure: float = 0.9, id_col: str = "doc_id", label_col: str = "quality") -> CoTrained:
    """Co-train on ``features``: at most ``sample`` labelled rows and all others."""
    known = pick(labels, id=id_col, y=label_col).select("id", F.expr("try_cast(y as int)").alias("y")).where("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").drop("top")
    ids = feats.where("id is not null").select("id").distinct()
    order = F.xxhash64(F.col("id").cast("string"))
    chosen = written(known.join(ids, "id", "left_semi").withColumn("order", order).orderBy("order", "id").limit(sample), "labelled")
    marked = feats.join(F.broadcast(chosen), "id").groupBy("id", "y", "order").agg(F.min(F.struct("meta", "ti", "tc")).alias("f"))  # at most ``sample`` rows
    rows = sorted((r["order"], r["id"], r["y"], *(bytes(r["f"][c]) for c in ("ti", "tc", "meta"))) for r in marked.collect())
    y = np.array([r[2] for r in rows], dtype=float)
    model = CoTrained(float(y.mean()) if len(y) else 1.0)
    parts = _parts(y)
    if parts is None:
        return model
    train, tune, weigh = (Batch.of_columns(*([rows[i][c] for i in p] for c in (3, 4, 5))) for p in parts)
    y_train, y_tune, y_weigh = (y[p] for p in parts)
    free = feats.join(F.broadcast(chosen.select("id")), "id", "left_anti")
    model.models = {v: Logistic(v) for v in VIEWS}
    sums: dict[str, dict] = {v: {} for v in VIEWS}
    for turn in range(rounds + 1):
        for v, m in model.models.items():
            m.fit(train, y_train, sums[v], 100 if turn == 0 else 40)
            model.own[v] = _calibrate(tune.margin(v, m.w, m.b)[:, None], y_tune)
        if turn < rounds:
            sums = pseudo_sums(free, model, sure)
    logit = model.logits(weigh)
    model.both = _calibrate(np.column_stack([logit[v] for v in VIEWS]), y_weigh)
    return model


def train(df: DataFrame, labels: DataFrame, sample: int = 4000, rounds: int = 3, sure: float = 0.9, id_col: str = "doc_id", label_col: str = "quality", **cols: str) -> CoTrained:
    """Co-train on documents: their features are written for it and removed afterwards."""
    feats = written(features(df, id_col=id_col, **cols), "features")
    model = fit(feats, labels, sample, rounds, sure, id_col, label_col)
    discard(feats)
    return model


def scores(feats: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """``id, text_score, meta_score, score, kept`` of every row of ``features``."""
    shared = feats.sparkSession.sparkContext.broadcast(model)  # 2**14 weights and a few more
    names = ["id", "text_score", "meta_score", "score", "kept"]

    def start():
        fitted = shared.value

        def step(batch: pa.RecordBatch):
            parts = [fitted.scores(part) for part in _slices([batch])]
            found = [np.concatenate(x) for x in zip(*parts)]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), *map(pa.array, found), pa.array(found[2] >= threshold)], names=names)

        return step

    return map_arrow(feats, f"id {feats.schema['id'].dataType.simpleString()}, text_score double, meta_score double, score double, kept boolean", start)


def classify(df: DataFrame, model: CoTrained, threshold: float = 0.5, **cols: str) -> DataFrame:
    """``id, text_score, meta_score, score, kept`` of every document."""
    return scores(features(df, **cols), model, threshold)


def keep_good(df: DataFrame, model: CoTrained, threshold: float = 0.5, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``df`` that the classifier keeps, with all their columns."""
    width = len(df.columns)
    flat = df.toDF(*[f"c{i}" for i in range(width)])
    at = {k: f"c{df.columns.index(c)}" for k, c in (("text", text_col), ("lang", lang_col), ("source", source_col), ("chars", chars_col))}
    extra = _inputs(flat, at["lang"], at["source"], at["chars"])
    shared, names, text = df.sparkSession.sparkContext.broadcast(model), list(extra), at["text"]

    def run(batches):
        lean()
        extract, fitted = Extractor(), shared.value
        for batch in batches:
            texts, rest = as_bytes(batch, text), [column(batch, c).to_pylist() for c in names]
            good: list[bool] = []
            for lo, hi in portions(texts, 512, 1 << 20):
                found = extract(*(x[lo:hi] for x in rest), texts[lo:hi])
                good += (fitted.scores(Batch.of_columns(*found))[2] >= threshold).tolist()
            yield batch.select(range(width)).filter(pa.array(good, pa.bool_()))

    schema = flat.schema
    return flat.select("*", *[c.alias(n) for n, c in extra.items()]).mapInArrow(run, schema).toDF(*df.columns)

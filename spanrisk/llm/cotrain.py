"""Quality classifier by co-training of a text view and a page-metadata view.

Two logistic models see different features of a document: the text model its words and coarse statistics of its
characters, the metadata model source, language and stated length. Both start from labelled rows. In each round, each
model scores all unlabelled rows, and those that it is sure of join the other model's training rows with its verdict.
At the end each view is calibrated on held-out labelled rows, a third logistic model weighs the two calibrated views,
and every document is scored where its text is read.

A view is sure of what reaches the confidence ``sure``, and in any case of its surest ``surest`` share of the unlabelled
rows on either side, found in a histogram of its scores over all of them. What falls short of ``sure`` counts by the
view's lift: how far its precision beyond that score, on held-out rows, lies above the share of the class, 0 to 1. A view
without any signal so gives pseudo-labels of no weight, and the report says so (``Views.lifts``).

Nothing is sampled. Feature numbers of all rows are staged once, with their labels: labels are looked up where features
are made, from arrays that every task holds, up to ``LABELS_HELD`` of them; more are joined in. A round counts features by
class over all training rows, chooses those that differ, stages the rows' chosen features, and adds up the gradient over
all of them for each step of the search (both views in one pass). A chosen feature occurs in ``min_share`` of the training
rows, so their number is bounded by the features of a row and does not grow with the rows; of features without any
difference, 6 in 100,000 reach ``min_z``. Calibration and cut-off come from histograms of all held-out rows. The driver
gets weights, gradients, histograms and at most ``LABELS_HELD`` labels.

A document is good if its quality label is 1 and it is not labelled toxic. Defined results: null and empty texts have
no words and are scored by what is left; null metadata is a value of its own; a key with several labels is good if
all are; with no labelled row of either class every document scores 0.5 and is kept; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanrisk.llm.common import release, slices, staged, texts_of
from spanrisk.llm.decontaminate import words
from spanrisk.llm.rule_forest import MARKS, SPACES, SYMBOLS, UPPER

CACHE_WORDS = 200_000  # of one task
#: Bytes of packed features that a pass unpacks at once (a longer row is unpacked alone).
PART_BYTES = 8 << 20
SHORT = 40
#: Of the table by which numbers without a weight are passed over.
LOW_BITS = 20
#: Labelled keys that every task holds (9 bytes each); more are joined to the features, which then move once.
LABELS_HELD = 8_000_000


@dataclass(frozen=True)
class CotrainParams:
    rounds: int = 3
    sure: float = 0.98  # confidence at which a pseudo-label counts in full
    surest: float = 0.05  # share of the unlabelled rows that a view labels on either side, at least
    pseudo_weight: float = 0.5
    holdout: int = 4  # one in four labelled rows calibrates
    min_rows: int = 5  # training rows that a feature occurs in, at least
    min_z: float = 4.0  # standard errors by which its classes differ, at least
    min_share: float = 0.0005  # of the training rows that a feature occurs in, at least
    ridge: float = 1e-3
    steps: int = 25  # passes over the training rows for one fit, at most
    logit_bins: int = 4  # of one unit of a view's logit, for calibration
    cut_bins: int = 256  # of one unit of the combined logit, for the cut-off
    max_good_loss: float = 0.005  # of the held-out good rows
    seed: int = 11


def _share(part: int, whole: int, name: bytes) -> bytes:
    """A feature for the size class of a share: none, below 1/512, ..., above a half. ``SHORT`` characters without
    any are added, as a share of a few characters says little."""
    level = 0 if not part else 10 - min(9, ((whole + SHORT) // part).bit_length() - 1)
    return b"\x00%b%d" % (name, level)


def text_features(text: bytes) -> set[bytes]:
    """Distinct words, and size classes of symbol, mark, capital and repeated-word shares."""
    doc = words(text)
    seen = set(doc)
    chars = len(text.translate(None, SPACES))
    if chars:
        seen.add(_share(chars - len(text.translate(None, SPACES + SYMBOLS)), chars, b"symbols"))
        seen.add(_share(chars - len(text.translate(None, SPACES + MARKS)), chars, b"marks"))
        seen.add(_share(chars - len(text.translate(None, SPACES + UPPER)), chars, b"capitals"))
    if len(doc) > 1:
        seen.add(_share(sum(map(bytes.__eq__, doc, doc[1:])), len(doc), b"same"))
    return seen


def meta_features(columns: list[str]) -> Column:
    """Array of strings: each column's value, each pair of text columns, and the size class of numbers."""
    out = []
    for c in columns:
        name, _, kind = c.partition(":")
        v = F.col(name)
        value = F.floor(2 * F.log2(F.greatest(v, F.lit(1)))) if kind == "size" else v
        out.append(F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("\x00"))))
    texts = [o for o, c in zip(out, columns) if ":" not in c]
    out += [F.concat(a, F.lit("|"), b) for i, a in enumerate(texts) for b in texts[i + 1:]]
    return F.array(*out)


def _number(feature: bytes) -> int:
    """40 bits: ten million words hit one of 4,000 chosen ones once in 25 cases."""
    import xxhash

    return xxhash.xxh64_intdigest(feature, 4) >> 24


def _packed(ids: np.ndarray) -> bytes:
    """Feature numbers in ascending order, as steps: their low four bytes, then their fifth."""
    steps = np.diff(np.sort(ids), prepend=0)
    return (steps & 0xFFFFFFFF).astype("<u4").tobytes() + (steps >> 32).astype("u1").tobytes()


def _unpacked(held: bytes) -> np.ndarray:
    n = len(held) // 5
    steps = np.frombuffer(held, "<u4", n).astype(np.int64) + (np.frombuffer(held, "u1", n, 4 * n).astype(np.int64) << 32)
    return np.cumsum(steps)


@dataclass
class Rows:
    """Sparse rows: feature numbers ``ids`` of row k at ``ends[k - 1]:ends[k]``."""

    ids: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(lists) -> Rows:
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        ids = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
        return Rows(ids, np.cumsum(sizes))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends)), np.diff(np.append(0, self.ends)))

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the sorted ``ids`` occur: place among them, row, place among this object's numbers. Most numbers are not
        among them, which a table of their low bits tells."""
        if not len(ids):
            return (np.zeros(0, np.int64),) * 3
        some = np.zeros(1 << LOW_BITS, bool)
        some[ids & (1 << LOW_BITS) - 1] = True
        maybe = np.flatnonzero(some[self.ids & (1 << LOW_BITS) - 1])
        at = np.minimum(np.searchsorted(ids, self.ids[maybe]), len(ids) - 1)
        real = ids[at] == self.ids[maybe]
        place = maybe[real]
        return at[real], np.searchsorted(self.ends, place, side="right"), place


@dataclass
class Linear:
    """Logistic model over the features ``ids`` (sorted)."""

    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def logit(self, rows: Rows) -> np.ndarray:
        at, row, _ = rows.find(self.ids)
        return self.bias + np.bincount(row, self.weight[at], minlength=len(rows.ends))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_dense(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights (last: bias) of a small logistic model by damped Newton steps, with a weak pull to the first weights.
    Each row of ``x`` stands for ``n`` rows."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        q = sigmoid(a @ w)
        grad = a.T @ (n * (q - y)) + 1e-2 * w
        w -= np.linalg.solve((a * (n * q * (1 - q))[:, None]).T @ a + np.eye(a.shape[1]) * 1e-1, grad)
    return w


def minimise(w: np.ndarray, scale: np.ndarray, steps: int):
    """L-BFGS as a generator: yields points, is sent (loss, gradient) of each, returns the best point, the number of
    points asked for (at most ``steps``) and the largest part of its gradient. ``scale``: a guess of the curvature in each
    direction."""
    f, g = yield w
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    asked = 1
    while asked < steps and np.abs(g).max() > 1e-6:
        d, used = g.copy(), []
        for s, v in reversed(pairs):
            used.append(s @ d / (s @ v))
            d -= used[-1] * v
        d /= scale
        if pairs:
            s, v = pairs[-1]
            d *= (s @ v) / (v @ (v / scale))
        for (s, v), a in zip(pairs, reversed(used)):
            d += s * (a - v @ d / (s @ v))
        t, slope = 1.0, -(g @ d)
        while asked < steps:
            f2, g2 = yield w - t * d
            asked += 1
            if f2 <= f + 1e-4 * t * slope:
                break
            t /= 4
        else:
            return w, asked, float(np.abs(g).max())
        s, v = -t * d, g2 - g
        if s @ v > 1e-14:
            pairs = [*pairs[-9:], (s, v)]
        done = f - f2 < 1e-5 * f
        w, f, g = w + s, f2, g2
        if done:
            break
    return w, asked, float(np.abs(g).max())


@dataclass
class Views:
    """The trained views, their calibrations (slope, bias), the combining weights and the cut-off."""

    text: Linear
    meta: Linear
    text_scale: np.ndarray
    meta_scale: np.ndarray
    blend: np.ndarray
    cut: float
    given: list[tuple[int, int]] = field(default_factory=list)  # pseudo-labels by the text and metadata view, by round
    lifts: list = field(default_factory=list)  # by round and view: lift on the bad and good side short of ``sure``
    fits: list = field(default_factory=list)  # by fit and view: steps of the search, largest part of the last gradient

    def blended(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.text_scale[0] * text + self.text_scale[1]
        b = self.meta_scale[0] * meta + self.meta_scale[1]
        return a, b, self.blend[0] * a + self.blend[1] * b + self.blend[2]

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(sigmoid(x) for x in self.blended(text, meta))


@dataclass
class Teacher:
    """Fitted models, and for each view and class (0 bad, 1 good) the logit's size from which it labels rows, and the
    weight of what is short of ``sure``."""

    models: list[Linear]
    limits: list[list[tuple[float, float]]]


@dataclass
class Part:
    """Some rows: their features in both views, y (1 good, 0 bad, -1 unlabelled), and which are held out."""

    views: tuple[Rows, Rows]
    y: np.ndarray
    held: np.ndarray

    def targets(self, teacher: Teacher | None, p: CotrainParams) -> list[tuple[np.ndarray, np.ndarray]]:
        """Label and weight (0: none) of each row in each view: labels, and what the other view's model is sure of."""
        base = np.where((self.y >= 0) & ~self.held, 1.0, 0.0)
        certain = np.log(p.sure / (1 - p.sure))
        out = []
        for k in (0, 1):
            label, weight = self.y.astype(float), base.copy()
            if teacher:
                said = teacher.models[1 - k].logit(self.views[1 - k])
                for side, (at, worth) in enumerate(teacher.limits[1 - k]):
                    size = said if side else -said
                    told = (self.y < 0) & (size >= at)
                    label[told], weight[told] = side, p.pseudo_weight * np.where(size[told] >= certain, 1.0, worth)
            out.append((label, weight))
        return out

    def spread(self, models: list[Linear], p: CotrainParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows by (3 * view + label of a held-out row, or + 2 for an unlabelled one; bin of the view's logit)."""
        kinds, cells = [], []
        use = (self.y < 0) | self.held
        for k in (0, 1):
            logit = models[k].logit(self.views[k])[use]
            kinds.append(3 * k + np.where(self.y[use] < 0, 2, self.y[use]))
            cells.append(np.floor(np.clip(logit, -35, 35) * p.cut_bins).astype(np.int64))
        kind, cell = np.concatenate(kinds), np.concatenate(cells)
        return _grouped(kind, cell, np.column_stack([np.ones(len(kind)), np.zeros((len(kind), 2))]))

    def counts(self, teacher: Teacher | None, p: CotrainParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(view, feature, (weight of good rows, of bad rows, pseudo-labels)); a view's totals are view + 2."""
        out = []
        for k, (label, weight) in enumerate(self.targets(teacher, p)):
            rows, good, bad = self.views[k], weight * (label > 0), weight * (label == 0)
            owner = rows.owner()
            live = weight[owner] > 0
            at, ids = pd.factorize(rows.ids[live])
            sums = [np.bincount(at, x[owner[live]], minlength=len(ids)) for x in (good, bad)]
            out.append((np.full(len(ids), k), ids, np.column_stack([*sums, np.zeros(len(ids))])))
            pseudo = ((weight > 0) & (self.y < 0)).sum()
            out.append((np.array([k + 2]), np.zeros(1, np.int64), np.array([[good.sum(), bad.sum(), pseudo]])))
        return tuple(np.concatenate(x) for x in zip(*out))

    def block(self, chosen: list[np.ndarray], teacher: Teacher | None, p: CotrainParams) -> list[np.ndarray]:
        """For each view: places of its ``chosen`` features, row by row, their number in each row, label, weight."""
        out = []
        for k, (label, weight) in enumerate(self.targets(teacher, p)):
            at, row, _ = self.views[k].find(chosen[k])
            live = weight[row] > 0
            n = np.bincount(row[live], minlength=len(weight))
            used = weight > 0
            out += [at[live].astype(np.int32), n[used].astype(np.int32), label[used].astype(np.float32),
                    weight[used].astype(np.float32)]
        return out

    def held_logits(self, models: list[Linear]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.held & (self.y >= 0))
        return self.y[at], *(models[k].logit(self.views[k])[at] for k in (0, 1))

    def cells(self, models: list[Linear], p: CotrainParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Held-out rows by (label, cell of both logits), with (rows, sums of the logits)."""
        y, a, b = self.held_logits(models)
        at = [np.floor(np.clip(x, -35, 35) * p.logit_bins).astype(np.int64) + 35 * p.logit_bins for x in (a, b)]
        return _grouped(y, at[0] * 100_000 + at[1], np.column_stack([np.ones(len(y)), a, b]))

    def bins(self, done: Views, p: CotrainParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Held-out rows by (label, bin of the combined logit)."""
        y, a, b = self.held_logits([done.text, done.meta])
        at = np.floor(np.clip(done.blended(a, b)[2], -35, 35) * p.cut_bins).astype(np.int64)
        return _grouped(y, at, np.column_stack([np.ones(len(y)), np.zeros((len(y), 2))]))


def _grouped(kind: np.ndarray, cell: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, at = np.unique(np.column_stack([kind, cell]).astype(np.int64), axis=0, return_inverse=True)
    return keys[:, 0], keys[:, 1], np.column_stack([np.bincount(at.ravel(), v, minlength=len(keys)) for v in values.T])


def descend(block: list[np.ndarray], points: list[np.ndarray | None]) -> list[np.ndarray]:
    """Loss and gradient (loss first) of each view over the rows of a block, empty where no point is given."""
    out = []
    for k, w in enumerate(points):
        if w is None:
            out.append(np.zeros(0))
            continue
        cols, n, label, weight = block[4 * k:4 * k + 4]
        owner = np.repeat(np.arange(len(n)), n)
        s = w[-1] + np.bincount(owner, w[cols], minlength=len(n))
        err = weight * (sigmoid(s) - label)
        loss = float((weight * (np.logaddexp(0, s) - label * s)).sum())
        out.append(np.concatenate([[loss], np.bincount(cols, err[owner], minlength=len(w) - 1), [err.sum()]]))
    return out


class Local:
    """Rows in memory."""

    def __init__(self, part: Part) -> None:
        self.part = part

    def sums(self, ask) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return ask(self.part)

    def features(self, teacher, p: CotrainParams):
        kind, ids, v = self.part.counts(teacher, p)
        totals = [v[kind == k + 2].sum(0) for k in (0, 1)]
        out = []
        for k in (0, 1):
            at = kind == k
            c1, c0, (n1, n0) = v[at, 0], v[at, 1], np.maximum(totals[k][:2], 1e-9)
            share = (c1 + c0) / (n1 + n0)
            z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
            good = np.flatnonzero((c1 + c0 >= max(p.min_rows, p.min_share * (n1 + n0))) & (z >= p.min_z))
            out.append((ids[at][good], (c1 + c0)[good]))
        return totals, out

    def blocks(self, chosen, teacher, p: CotrainParams):
        block = self.part.block(chosen, teacher, p)
        return lambda points: descend(block, points)

    def end(self) -> None:
        pass


SUMS = "kind int, cell bigint, a double, b double, c double"
BLOCK = T.StructType([T.StructField(f"b{i}", T.BinaryType()) for i in range(8)])
BLOCK_TYPES = [np.int32, np.int32, np.float32, np.float32] * 2


class Stored:
    """Rows of a staged table (y, held, ids, meta_ids), passed over in Spark. What reaches the driver: counts of the
    chosen features, one gradient of each task, and histograms."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows, self.spark, self.path = rows, rows.sparkSession, None

    def _sums(self, ask) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                kind, cell, v = ask(part)
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(cell, pa.int64()),
                                                  *[pa.array(x, pa.float64()) for x in v.T]], names=["kind", "cell", "a", "b", "c"])

        return self.rows.mapInArrow(run, SUMS).groupBy("kind", "cell").agg(
            *[F.sum(c).alias(c) for c in "abc"])

    def sums(self, ask) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = self._sums(ask).orderBy("kind", "cell").toPandas()
        return got["kind"].to_numpy(), got["cell"].to_numpy(), got[["a", "b", "c"]].to_numpy()

    def features(self, teacher, p: CotrainParams):
        held = self.spark.sparkContext.broadcast(teacher)
        counted, path = staged(self._sums(lambda part: part.counts(held.value, p)), "feature-counts")
        totals = [np.zeros(3), np.zeros(3)]
        for r in counted.filter("kind >= 2").collect():
            totals[r["kind"] - 2] = np.array([r["a"], r["b"], r["c"]])
        out = []
        for k in (0, 1):
            n1, n0 = (float(x) for x in np.maximum(totals[k][:2], 1e-9))
            share = (F.col("a") + F.col("b")) / (n1 + n0)
            z = F.abs(F.col("a") / n1 - F.col("b") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
            top = (counted.filter(F.col("kind") == k).select("cell", (F.col("a") + F.col("b")).alias("n"), z.alias("z"))
                   .filter((F.col("n") >= max(p.min_rows, p.min_share * (n1 + n0))) & (F.col("z") >= p.min_z))
                   .select("cell", "n").toPandas())
            out.append((top["cell"].to_numpy(np.int64), top["n"].to_numpy(float)))
        release(self.spark, path)
        return totals, out

    def blocks(self, chosen, teacher, p: CotrainParams):
        self.end()
        held = self.spark.sparkContext.broadcast((chosen, teacher))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                block = part.block(*held.value, p)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in block],
                                                 names=BLOCK.names)

        packed, self.path = staged(self.rows.mapInArrow(pack, BLOCK), "training-blocks")

        def gradient(points: list[np.ndarray | None]) -> list[np.ndarray]:
            at = self.spark.sparkContext.broadcast(points)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = None
                for batch in batches:
                    for i in range(batch.num_rows):
                        block = [np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in enumerate(BLOCK_TYPES)]
                        new = descend(block, at.value)
                        total = new if total is None else [a + b for a, b in zip(total, new)]
                if total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in total],
                                                     names=["text", "meta"])

            got = packed.mapInArrow(run, "text binary, meta binary").collect()
            at.unpersist()
            return [sum((np.frombuffer(r[k]) for r in got), np.zeros(0 if w is None else len(w) + 1))
                    for k, w in enumerate(points)]

        return gradient

    def end(self) -> None:
        if self.path:
            release(self.spark, self.path)
            self.path = None


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, "ids", PART_BYTES)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    return map(_part, _slices(batches))


def _part(batch: pa.RecordBatch) -> Part:
    views = [Rows.of([_unpacked(x) for x in batch.column(name).to_pylist()]) for name in ("ids", "meta_ids")]
    return Part(tuple(views), batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64),
                batch.column("held").to_numpy(zero_copy_only=False).astype(bool))


def teach(data, models: list[Linear], p: CotrainParams) -> Teacher:
    """From which logits on each view labels rows, and what that is worth, by histograms of all unlabelled and all
    held-out rows."""
    kind, cell, v = data.sums(lambda part: part.spread(models, p))
    certain = np.log(p.sure / (1 - p.sure))
    limits = []
    for k in (0, 1):
        sides = []
        for side in (0, 1):
            size = (cell if side else -cell - 1) / p.cut_bins  # of the logit on this side, at least
            here = (kind == 3 * k + 2) & (size > 0)
            order = np.argsort(-size[here])
            held = np.cumsum(v[here, 0][order])
            enough = np.searchsorted(held, p.surest * v[kind == 3 * k + 2, 0].sum())
            at = min([certain, *size[here][order][:enough + 1]])
            own, other = (v[(kind == 3 * k + c) & (size >= at), 0].sum() for c in (side, 1 - side))
            every = [v[kind == 3 * k + c, 0].sum() for c in (side, 1 - side)]
            base = every[0] / max(sum(every), 1)
            lift = (own / (own + other) - base) / (1 - base) if own + other and base < 1 else 0.0
            sides.append((float(at), float(np.clip(lift, 0, 1))))
        limits.append(sides)
    return Teacher(models, limits)


def _fit_views(data, teacher: Teacher | None, p: CotrainParams, fits: list) -> tuple[list[Linear], tuple[int, int]]:
    """Both views' models, fitted on labels and on what the ``teacher`` is sure of, and the pseudo-labels that each view
    gave. A view's features are those whose share differs between the classes."""
    models = teacher and teacher.models
    totals, found = data.features(teacher, p)
    fits.append([None, None])
    given = (int(totals[1][2]), int(totals[0][2]))
    order = [np.argsort(ids) for ids, _ in found]
    ids = [x[0][o] for x, o in zip(found, order)]
    out: list[Linear | None] = [None, None]
    searches, points = [None, None], [None, None]
    for k, (n1, n0, _) in enumerate(totals):
        if not n1 or not n0:
            out[k] = Linear(bias=4.0 if n1 else -4.0 if n0 else 0.0)
            continue
        start = np.append(np.zeros(len(ids[k])), np.log(n1 / n0))
        if models:
            old = dict(zip(models[k].ids.tolist(), models[k].weight))
            start[:-1] = [old.get(i, 0.0) for i in ids[k].tolist()]
            start[-1] = models[k].bias
        share = found[k][1][order[k]] / (n1 + n0)
        searches[k] = minimise(start, np.append(share * (1 - share) / 4 + p.ridge, 0.25), p.steps)
        points[k] = next(searches[k])
    gradient = data.blocks(ids, teacher, p) if any(s is not None for s in searches) else None
    while any(w is not None for w in points):
        got = gradient(points)
        for k, w in enumerate(points):
            if w is None:
                continue
            n = totals[k][0] + totals[k][1]
            grad = got[k][1:] / n + p.ridge * np.append(w[:-1], 0.0)
            loss = got[k][0] / n + p.ridge / 2 * float(w[:-1] @ w[:-1])
            try:
                points[k] = searches[k].send((loss, grad))
            except StopIteration as end:
                best, *fits[-1][k] = end.value
                points[k], out[k] = None, Linear(ids[k], best[:-1], float(best[-1]))
    return out, given


def train(data, p: CotrainParams) -> Views:
    fits: list = []
    models, _ = _fit_views(data, None, p, fits)
    told, lifts = [], []
    for _ in range(p.rounds):
        teacher = teach(data, models, p)
        models, given = _fit_views(data, teacher, p, fits)
        told.append(given)
        lifts.append([[worth for _, worth in sides] for sides in teacher.limits])
    data.end()
    done = calibrate(data, models, told, p)
    done.lifts, done.fits = lifts, fits
    return done


def calibrate(data, models: list[Linear], given: list[tuple[int, int]], p: CotrainParams) -> Views:
    """Calibrations, combining weights and cut-off from histograms of all held-out rows."""
    truth, _, v = data.sums(lambda part: part.cells(models, p))
    if not len(truth) or truth.min() == truth.max():
        return Views(Linear(), Linear(), np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.zeros(3), 0.0, given)
    n, truth = v[:, 0], truth.astype(float)
    raw = [v[:, 1] / n, v[:, 2] / n]
    scale = [fit_dense(r[:, None], truth, n) for r in raw]
    calibrated = np.column_stack([s[0] * r + s[1] for s, r in zip(scale, raw)])
    done = Views(*models, *scale, fit_dense(calibrated, truth, n), 0.0, given)
    kind, at, v = data.sums(lambda part: part.bins(done, p))
    done.cut = choose_cut(at, kind, v[:, 0], p)
    return done


def choose_cut(at: np.ndarray, truth: np.ndarray, n: np.ndarray, p: CotrainParams) -> float:
    """The score below which rows are rejected: as many bad rows as possible, at most ``max_good_loss`` of the good
    ones. ``n`` rows of class ``truth`` are in bin ``at`` of the combined logit."""
    ends = np.unique(at)
    held = [np.zeros(len(ends)), np.zeros(len(ends))]
    for k in (0, 1):
        np.add.at(held[k], np.searchsorted(ends, at[truth == k]), n[truth == k])
    if not held[0].sum() or not held[1].sum():
        return 0.0
    caught, lost = (np.append(0.0, np.cumsum(h)) / h.sum() for h in held)  # by a cut above the first k bins
    gain = np.where(lost <= p.max_good_loss, caught - lost, -1)
    best = int(np.argmax(gain))
    if not best:
        return 0.0
    # between the last bin that goes and the first that stays
    cut = (ends[best - 1] + 1 + (ends[best] if best < len(ends) else ends[best - 1] + 1)) / 2 / p.cut_bins
    return float(sigmoid(np.array(cut)))


def cotrain(text: Rows, meta: Rows, y: np.ndarray, p: CotrainParams) -> Views:
    """``y``: 1 good, 0 bad, -1 unlabelled, for each row of both views, in memory."""
    held = np.zeros(len(y), dtype=bool)
    held[np.flatnonzero(y >= 0)[::p.holdout]] = True
    return train(Local(Part((text, meta), y, held)), p)


def _features(docs: DataFrame, labels: DataFrame, key: str, text: str, meta: list[str], p: CotrainParams,
              labels_held: int = LABELS_HELD) -> DataFrame:
    """key, y, held, ids and meta_ids of every row. ``labels``: (key, good), a row per key. Up to ``labels_held`` of them go
    to all tasks as sorted arrays, and no feature moves; more are joined to the features."""
    from pyspark.sql.pandas.types import to_arrow_schema

    few = labels.count() <= labels_held
    number = F.col(key).cast("bigint") if isinstance(docs.schema[key].dataType, T.IntegralType) else F.xxhash64(key)
    drawn = F.pmod(F.xxhash64(F.lit(p.seed), key), F.lit(p.holdout)) == 0
    rows = docs.select(F.col(key).alias("key"), F.when(F.col(key).isNotNull(), number).alias("number"), drawn.alias("drawn"),
                       F.col(text).alias("text"), meta_features(meta).alias("meta"))
    out = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("drawn", T.BooleanType()),
                        T.StructField("y", T.ByteType()), T.StructField("ids", T.BinaryType()),
                        T.StructField("meta_ids", T.BinaryType())])
    arrow = to_arrow_schema(out)
    table = None
    if few:
        known = labels.select(number.alias("number"), F.col("good").cast("tinyint")).orderBy("number").toPandas()
        table = docs.sparkSession.sparkContext.broadcast(
            (known["number"].to_numpy(np.int64), known["good"].to_numpy(np.int8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        keys, good = table.value if table else (np.zeros(0, np.int64), np.zeros(0, np.int8))
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [_packed(np.array([numbers[f] for f in text_features(t)], dtype=np.int64))
                       for t in texts_of(part, "text")]
                metas = [_packed(np.array([numbers[m.encode("utf-8", "surrogatepass")] for m in ms], dtype=np.int64))
                         for ms in part.column("meta").to_pylist()]
                y = np.full(part.num_rows, -1, np.int8)
                if len(keys):
                    own = part.column("number")
                    wanted = own.fill_null(0).to_numpy(zero_copy_only=False)
                    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    y = np.where((keys[at] == wanted) & own.is_valid().to_numpy(zero_copy_only=False), good[at], y)
                yield pa.RecordBatch.from_arrays([
                    part.column("key").cast(arrow.field("key").type), part.column("drawn"), pa.array(y, pa.int8()),
                    pa.array(ids, arrow.field("ids").type), pa.array(metas, arrow.field("meta_ids").type)], schema=arrow)

    rows = rows.mapInArrow(run, out)
    if not few:
        rows = rows.drop("y").join(labels.withColumnRenamed(key, "key"), "key", "left").withColumn(
            "y", F.coalesce("good", F.lit(-1)).cast("tinyint"))
    return rows.select("key", "y", (F.col("drawn") & (F.col("y") >= 0)).alias("held"), "ids", "meta_ids")


def _stored(docs: DataFrame, labels: DataFrame, key: str, text: str, meta: tuple[str, ...], p: CotrainParams):
    good = F.min(F.when((F.col("quality") > 0) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0))
    labels = (labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(key)
              .agg(good.alias("good")))
    return staged(_features(docs, labels, key, text, list(meta), p), "cotrain-features")


META = ("source", "lang", "n_chars:size")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", meta: tuple[str, ...] = META,
        p: CotrainParams = CotrainParams()) -> Views:
    """``labels``: (key, quality, toxic). ``meta``: columns, ``name:size`` for numbers taken by size class."""
    rows, path = _stored(docs, labels, key, text, meta, p)
    views = train(Stored(rows), p)
    release(docs.sparkSession, path)
    return views


def classify_keys(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                  meta: tuple[str, ...] = META, p: CotrainParams = CotrainParams()) -> DataFrame:
    """Key, scores and kept of every row, scored by its stored features: the texts are read once."""
    rows, path = _stored(docs, labels, key, text, meta, p)
    views = train(Stored(rows), p)
    held = docs.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for some in _slices(batches):
            part = _part(some)
            scores = v.score(v.text.logit(part.views[0]), v.meta.logit(part.views[1]))
            yield pa.RecordBatch.from_arrays([some.column("key"), *[pa.array(x, pa.float64()) for x in scores]],
                                             names=["key", *[f.name for f in SCORES]])

    schema = T.StructType([rows.schema["key"], *SCORES])
    out, _ = staged(rows.mapInArrow(run, schema), "cotrain-scores")
    release(docs.sparkSession, path)
    return out.withColumnRenamed("key", key).withColumn("kept", F.col("score") >= F.lit(views.cut))


class _Numbers(dict):
    """Feature -> number, kept up to a bound."""

    def __missing__(self, feature: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        n = self[feature] = _number(feature)
        return n


class _Weights(dict):
    """Feature -> weight, looked up by number and kept, up to a bound."""

    def __init__(self, model: Linear) -> None:
        super().__init__()
        self.by_number = dict(zip(model.ids.tolist(), model.weight.tolist()))

    def __missing__(self, feature: bytes) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        w = self[feature] = self.by_number.get(_number(feature), 0.0)
        return w


SCORES = [T.StructField(n, T.DoubleType()) for n in ("text_score", "meta_score", "score")]


def score(docs: DataFrame, views: Views, text: str = "text",
          meta: tuple[str, ...] = META) -> DataFrame:
    """``docs`` with text_score, meta_score, score (all probabilities of being good) and kept."""
    from pyspark.sql.pandas.types import to_arrow_schema

    held = docs.sparkSession.sparkContext.broadcast(views)
    names = {f.name for f in SCORES}
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in names])
    schema = T.StructType([*kept.schema.fields, *SCORES])
    arrow = to_arrow_schema(schema)
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        weights, metas = _Weights(v.text), _Weights(v.meta)
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                a = [v.text.bias + sum(map(weights.__getitem__, sorted(text_features(t))))
                     for t in texts_of(part, part.schema.names[at])]
                b = [v.meta.bias + sum(metas[m.encode("utf-8", "surrogatepass")] for m in ms)
                     for ms in part.column(part.num_columns - 1).to_pylist()]
                scores = v.score(np.array(a), np.array(b))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i).cast(arrow.field(i).type) for i in range(part.num_columns - 1)],
                     *[pa.array(x, pa.float64()) for x in scores]], schema=arrow)

    # the texts go to the tasks once and come back once; the metadata's features go along as a column of their own
    scored = kept.select("*", meta_features(list(meta)).alias("__meta")).mapInArrow(run, schema)
    return scored.withColumn("kept", F.col("score") >= F.lit(views.cut))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
             meta: tuple[str, ...] = META,
             p: CotrainParams = CotrainParams()) -> DataFrame:
    """``docs`` with the scores and kept; columns of those names are replaced."""
    return score(docs, fit(docs, labels, key, text, meta, p), text, meta)

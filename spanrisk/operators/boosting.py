"""Boosted trees for two classes, trained by histograms over blocks of binned rows; the result is a Spark ML model.

The method is that of Spark ML's ``GBTClassifier``: log loss on labels -1 and 1, regression trees on its negative
gradient, at most 32 bins an input, a row drawn for a tree with the subsampling rate, the first tree with weight 1 and
the others with the step size. What differs is how rows are held and passed over. A row is 12 bytes of bins (two inputs
in 16 bits), its label and its score so far, in blocks of numpy columns, where Spark ML holds an object of 256 bytes and
sums it up input by input. A level of a tree is one pass that returns counts, sums and squares by node, input and bin;
of two sister nodes only the smaller one is counted, the other is the difference from their parent.

A state of the scores lives for ``STATE_TREES`` trees (memory, else disk) and is made from the one before; every
``CHECKPOINT``-th is written to the checkpoint folder, so that what a lost executor held is made again from there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanrisk.session import drop_path, ensure_checkpoint_dir

# tasks get these functions themselves, so executors need numpy only
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
_BITS = 5
_PAIR = 1 << 2 * _BITS  # cells of two inputs
BLOCK_ROWS = 1 << 17
#: Trees after which scores are stored anew; until then a pass adds their values itself.
STATE_TREES = 4
#: States after which one is written to the checkpoint folder.
CHECKPOINT = 3
#: Rank error of the quantiles that cut an input of more than ``BINS`` values.
QUANTILE_ERROR = 0.001
#: Partitions whose sums come to the driver one by one; those of more are added up in Spark first.
DIRECT = 256


def _values(batch, filled: list[float]) -> Iterator[np.ndarray]:
    """Each input of an Arrow batch as doubles, null and NaN replaced by its fill."""
    for i, fill in enumerate(filled):
        v = batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64)
        yield np.where(np.isnan(v), fill, v)


def _few_values(df: DataFrame, cols: list[str], filled: list[float]) -> list[list[float]]:
    """The distinct values of each input, or more than ``BINS`` of them where it has more."""
    import pyarrow as pa

    def run(batches):
        seen = [np.zeros(0)] * len(cols)
        for batch in batches:
            for i, v in enumerate(_values(batch, filled)):
                if len(seen[i]) <= BINS:
                    seen[i] = np.unique(np.append(seen[i], np.unique(v)))[:BINS + 1]
        rows = [(i, x) for i, s in enumerate(seen) for x in s.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                          pa.array([r[1] for r in rows], pa.float64())], names=["i", "v"])

    found: list[list[float]] = [[] for _ in cols]
    for r in df.select(*cols).mapInArrow(run, "i int, v double").distinct().collect():
        found[r["i"]].append(r["v"])
    return [sorted(x) for x in found]


def find_thresholds(df: DataFrame, cols: list[str], filled: list[float]) -> list[np.ndarray]:
    """Where each input may be cut (a row goes left if it is that value at most): between its values if there are few, else
    at quantiles of all rows, and also below a value that holds several of them."""
    few = _few_values(df, cols, filled)
    many = [c for c, v in zip(cols, few) if len(v) > BINS]
    at = [k / BINS for k in range(1, BINS)]
    quantiles = {}
    if many:
        value = {c: F.when(F.col(c).isNull() | F.isnan(c), F.lit(fill)).otherwise(F.col(c)).alias(c)
                 for c, fill in zip(cols, filled) if c in many}
        quantiles = dict(zip(many, df.select(*value.values()).approxQuantile(many, at, QUANTILE_ERROR)))
    out = []
    for c, v in zip(cols, few):
        if c in quantiles:
            cut, times = np.unique(quantiles[c], return_counts=True)
            cut = np.union1d(cut, np.nextafter(cut[times > 1], -np.inf))
        else:
            low, high = np.array(v[:-1], np.float64), np.array(v[1:], np.float64)
            middle = low / 2 + high / 2
            cut = np.where((low <= middle) & (middle < high), middle, low)
        out.append(cut)
    return out


@dataclass
class Tree:
    """Nodes by number, the root 0, children behind their parents. ``feature`` is -1 in a leaf; a row goes left if its
    bin is ``bin`` at most. ``stats``: drawn rows, and the sum and squares of what the tree is fitted to."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    stats: list[np.ndarray] = field(default_factory=list)

    def add(self, stats: np.ndarray) -> int:
        for column, value in ((self.feature, -1), (self.bin, 0), (self.left, len(self.left)), (self.gain, 0.0)):
            column.append(value)
        self.stats.append(stats)
        return len(self.feature) - 1

    def value(self) -> np.ndarray:
        return np.array([s[1] / s[0] if s[0] else 0.0 for s in self.stats])


@dataclass
class _Route:
    """What a task needs of a tree: its split nodes, parents first, as (node, input, bin, left child)."""

    splits: list[tuple[int, int, int, int]]

    @classmethod
    def of(cls, tree: Tree) -> _Route:
        return cls([(k, f, tree.bin[k], tree.left[k]) for k, f in enumerate(tree.feature) if f >= 0])

    def members(self, pairs: np.ndarray) -> dict[int, np.ndarray]:
        """Whether each row is in a node, for the nodes that are not split."""
        inside = {0: np.ones(pairs.shape[1], bool)}
        for node, feature, at, left in self.splits:
            here = inside.pop(node)
            inside[left + 1] = here & _over(pairs[feature >> 1], feature, at)
            inside[left] = here ^ inside[left + 1]
        return inside

    def nodes(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(pairs.shape[1], np.uint8)
        for node, inside in self.members(pairs).items():
            out += inside * np.uint8(node)
        return out


def _over(pair: np.ndarray, feature: int, at: int) -> np.ndarray:
    """Whether the bin of one of a pair's inputs is above ``at``."""
    return pair & np.uint16(BINS - 1) > np.uint16(at) if feature & 1 else pair >= np.uint16(at + 1 << _BITS)


def _pack(thresholds: list[np.ndarray], filled: list[float]):
    """Arrow batches of inputs and label -> blocks: pairs of bins, and labels -1 and 1."""
    import pyarrow as pa

    n_pairs = (len(filled) + 1) // 2

    def run(batches):
        held, labels, rows = [], [], 0

        def block():
            pairs, y = np.concatenate(held, axis=1), np.concatenate(labels)
            return pa.RecordBatch.from_arrays([pa.array([pairs.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())],
                                              names=["pairs", "label"])

        for batch in batches:
            if not batch.num_rows:
                continue
            pairs = np.zeros((n_pairs, batch.num_rows), np.uint16)
            for i, v in enumerate(_values(batch, filled)):
                bins = np.searchsorted(thresholds[i], v, "left").astype(np.uint16)
                pairs[i >> 1] |= bins if i & 1 else bins << _BITS
            held.append(pairs)
            y = batch.column(len(filled)).to_numpy(zero_copy_only=False)
            labels.append(np.where(y > 0, 1, -1).astype(np.int8))
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield block()
                held, labels, rows = [], [], 0
        if rows:
            yield block()

    return run


def _target(label: np.ndarray, score: np.ndarray, first: bool) -> np.ndarray:
    """What a tree is fitted to: the label, then the negative gradient of 2 log(1 + exp(-2 label score))."""
    if first:
        return label.astype(np.float64)
    with np.errstate(over="ignore"):
        return 4.0 * label / (1.0 + np.exp(2.0 * label * score))


def _drawn(n: int, rate: float, *seed: int) -> np.ndarray:
    if rate >= 1:
        return np.ones(n, bool)
    return np.random.default_rng(seed).random(n, dtype=np.float32) < rate


def _count(rows: Iterator[tuple], part: int, n_features: int, slots: list[int], route: _Route, scored: list[tuple],
           tree: int, rate: float, seed: int) -> np.ndarray:
    """Rows, sums and squares by slot (a node that is counted), input and bin, over some blocks. ``scored``: routes and
    values of trees that the stored scores lack."""
    total = np.zeros((3, len(slots), n_features, BINS))
    for k, pairs, label, score in rows:
        label = np.frombuffer(label, np.int8)
        pairs = np.frombuffer(pairs, np.uint16).reshape(-1, len(label))
        drawn = _drawn(len(label), rate, seed, tree, part, k)
        score = np.frombuffer(score, np.float64)
        later = [(r.nodes(pairs), value) for r, value in scored]
        members = route.members(pairs)
        for i, slot in enumerate(slots):
            pick = np.flatnonzero(drawn & members[slot])
            own = score.take(pick)
            for nodes, value in later:
                own += value.take(nodes.take(pick))
            y = _target(label.take(pick), own, tree == 0)
            weights = (None, y, y * y)
            for p in range(len(pairs)):
                cell = pairs[p].take(pick).astype(np.intp)
                for s, w in enumerate(weights):
                    sums = np.bincount(cell, w, _PAIR).reshape(BINS, BINS)
                    total[s, i, 2 * p] += sums.sum(axis=1)
                    if 2 * p + 1 < n_features:
                        total[s, i, 2 * p + 1] += sums.sum(axis=0)
    return total


def best_split(stats: np.ndarray, n_cuts: list[int]) -> tuple[float, int, int, np.ndarray] | None:
    """Gain, input, bin and left sums of the split that lowers the variance most, the first of equals; None without one.
    ``stats``: rows, sums and squares by input and bin."""
    whole = stats[:, 0].sum(axis=1)
    left = np.cumsum(stats, axis=2)
    right = whole[:, None, None] - left
    cut = np.arange(BINS)[None, :] < np.array(n_cuts)[:, None]
    fine = cut & (left[0] >= 1) & (right[0] >= 1)
    if not fine.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - whole[1] ** 2 / whole[0]) / whole[0]
    gain = np.where(fine, gain, -np.inf)
    feature, at = divmod(int(np.argmax(gain)), BINS)
    if gain[feature, at] <= 1e-15 * max(1.0, whole[2] / whole[0]):  # no more than the rounding of the sums
        return None
    return float(gain[feature, at]), feature, at, left[:, feature, at]


class _Rows:
    """The blocks with their scores, and the passes over them."""

    def __init__(self, blocks: DataFrame, n_features: int, rate: float, seed: int):
        from pyspark import StorageLevel

        self.level, self.n_features, self.rate, self.seed = StorageLevel.MEMORY_AND_DISK, n_features, rate, seed
        self.spark = blocks.sparkSession
        ensure_checkpoint_dir(self.spark)
        self.state = blocks.rdd.mapPartitions(
            lambda rows: ((k, bytes(r[0]), bytes(r[1]), bytes(8 * len(r[1]))) for k, r in enumerate(rows)))
        self.state.persist(self.level)
        self.scored: list[tuple] = []
        self.states = 0
        self.old: list = []
        self.files: list[str] = []

    def count(self, slots: list[int], grown: Tree, tree: int) -> np.ndarray:
        """``_count`` over all rows, for these nodes of the tree as it has grown."""
        n_features, rate, seed, scored, route = self.n_features, self.rate, self.seed, self.scored, _Route.of(grown)

        def run(part, rows):
            yield _count(rows, part, n_features, slots, route, scored, tree, rate, seed)

        sums = self.state.mapPartitionsWithIndex(run)
        if sums.getNumPartitions() > DIRECT:
            total = sums.treeReduce(np.add)
        else:
            total = sum(sums.collect(), np.zeros((3, len(slots), n_features, BINS)))
        # the state is there now, so what it was made from may go
        while self.old:
            self.old.pop().unpersist()
        while len(self.files) > 1:
            drop_path(self.spark, self.files.pop(0))
        return total

    def score(self, tree: Tree, weight: float) -> None:
        """Add the tree's values to the scores: on every pass until the next state, then for good."""
        self.scored = [*self.scored, (_Route.of(tree), tree.value() * weight)]
        if len(self.scored) < STATE_TREES:
            return
        scored, self.scored = self.scored, []

        def run(rows):
            for k, pairs, label, score in rows:
                bins = np.frombuffer(pairs, np.uint16).reshape(-1, len(label))
                new = np.frombuffer(score, np.float64)
                for route, value in scored:
                    new = new + value.take(route.nodes(bins))
                yield k, pairs, label, new.tobytes()

        new = self.state.mapPartitions(run, preservesPartitioning=True)
        new.persist(self.level)
        self.old.append(self.state)
        self.state = new
        self.states += 1
        if self.states % CHECKPOINT == 0:
            new.checkpoint()
            new.foreachPartition(lambda rows: None)
            self.files.append(new.getCheckpointFile())

    def close(self) -> None:
        for held in (*self.old, self.state):
            held.unpersist()
        for path in self.files:
            drop_path(self.spark, path)


def _grow(rows: _Rows, number: int, n_cuts: list[int], depth: int) -> Tree:
    """One tree, a pass for each level."""
    root = rows.count([0], Tree(), number)[:, 0]
    tree = Tree()
    open_nodes = {tree.add(root[:, 0].sum(axis=1)): root}
    for level in range(depth):
        smaller, parents = [], {}
        for node, stats in open_nodes.items():
            found = best_split(stats, n_cuts)
            if found is None:
                continue
            gain, feature, at, left = found
            whole = tree.stats[node]
            first, second = tree.add(left), tree.add(whole - left)
            tree.feature[node], tree.bin[node], tree.left[node], tree.gain[node] = feature, at, first, gain
            low, high = (first, second) if left[0] * 2 <= whole[0] else (second, first)
            smaller.append(low)
            parents[low] = (high, stats)
        if not smaller or level == depth - 1:
            break
        counted = rows.count(smaller, tree, number)
        open_nodes = {}
        for k, low in enumerate(smaller):
            high, stats = parents[low]
            open_nodes[low], open_nodes[high] = counted[:, k], stats - counted[:, k]
        open_nodes = dict(sorted(open_nodes.items()))
    return tree


def train(df: DataFrame, cols: list[str], fills: dict[str, float], n_trees: int, depth: int, step: float, rate: float,
          seed: int, label: str = "label") -> tuple[list[Tree], list[np.ndarray]]:
    """Trees (the first has weight 1, the others ``step``) and thresholds of the inputs. ``df`` is best a stored table."""
    if depth > 7:
        raise ValueError("trees of at most 7 levels")  # nodes are numbered in 8 bits
    filled = [fills[c] for c in cols]
    inputs = df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(label).cast("int").alias("label"))
    thresholds = find_thresholds(inputs, list(cols), filled)
    blocks = inputs.mapInArrow(_pack(thresholds, filled), "pairs binary, label binary")
    rows = _Rows(blocks, len(cols), rate, seed)
    try:
        trees: list[Tree] = []
        n_cuts = [len(t) for t in thresholds]
        for number in range(n_trees):
            if trees:
                rows.score(trees[-1], 1.0 if number == 1 else step)
            trees.append(_grow(rows, number, n_cuts, depth))
            if not trees[-1].stats[0][0]:
                raise ValueError("no training rows")
    finally:
        rows.close()
    return trees, thresholds


def spark_model(classifier, trees: list[Tree], thresholds: list[np.ndarray], spark):
    """The trees as the model that the Spark ML ``classifier`` would return: it transforms, saves and loads like one."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    ml = jvm.org.apache.spark.ml
    stats_of = jvm.org.apache.spark.mllib.tree.impurity.ImpurityCalculator

    def doubles(values):
        out = gateway.new_array(jvm.double, len(values))
        for i, v in enumerate(values):
            out[i] = float(v)
        return out

    def node(tree: Tree, k: int):
        n, total, squares = (float(x) for x in tree.stats[k])
        mean = total / n
        impurity = max(0.0, squares / n - mean * mean)
        stats = stats_of.getCalculator("variance", doubles(tree.stats[k]), int(n))
        f = tree.feature[k]
        if f < 0:
            return ml.tree.LeafNode(mean, impurity, stats)
        split = ml.tree.ContinuousSplit(f, float(thresholds[f][tree.bin[k]]))
        left, right = node(tree, tree.left[k]), node(tree, tree.left[k] + 1)
        return ml.tree.InternalNode(mean, impurity, tree.gain[k], left, right, split, stats)

    kind = ml.regression.DecisionTreeRegressionModel
    out = gateway.new_array(kind, len(trees))
    for i, tree in enumerate(trees):
        out[i] = kind(f"dtr_{classifier.uid}_{i}", node(tree, 0), len(thresholds))
    weights = doubles([1.0] + [classifier.getStepSize()] * (len(trees) - 1))
    java = ml.classification.GBTClassificationModel(classifier.uid, out, weights, len(thresholds), 2)
    return classifier._copyValues(classifier._create_model(java))

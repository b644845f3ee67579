"""Quality rules: exact rule statistics of every text, and an isolation forest over them.

One pass over the texts counts the statistics (numpy in each task, no shuffle). An isolation forest draws, for each
tree, a random sample of documents and splits it at random; rows that end up alone after few splits are anomalous.
The sample is the method's own: ``trees * psi`` documents at most, chosen by a hash of the id, so it does not depend
on partitions. Every document is scored, and the cut-off comes from a histogram of the scores of all labelled rows:
the lowest score at which no more than ``max_good_loss`` of the good rows are lost.

Defined results: null and empty texts have no words, so they fail the base rule; repeated rows are scored alike; with
no labels, or with no labelled row of either class, only the base rule decides; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanrisk.llm.common import staged, with_text_columns

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
GRAM = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

COUNTS = [T.StructField(n, T.LongType()) for n in
          ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")]


@dataclass(frozen=True)
class ForestParams:
    trees: int = 100
    psi: int = 256  # documents per tree
    seed: int = 7
    max_good_loss: float = 0.003  # of the labelled good rows
    bins: int = 2000  # of the score histogram


def _pair(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Codes below ``len(a)`` that are equal where both parts are equal."""
    return np.unique(a * n + b, return_inverse=True)[1].astype(np.int64)


def repeat_words(docs: list[list[bytes]]) -> list[int]:
    """For each text, how many words lie in a 5-word window that it holds twice or more."""
    lens = np.array([len(d) for d in docs], dtype=np.int64)
    total = int(lens.sum())
    if total < GRAM:
        return [0] * len(docs)
    ids, base = [], 0
    for d in docs:  # numbers of one text's words differ from all others', so windows of two texts never match
        ids += map({}.setdefault, d, range(base, base + len(d)))
        base += len(d)
    ids = np.array(ids, dtype=np.int64)
    owner = np.repeat(np.arange(len(docs)), lens)
    two = _pair(ids[:-1], ids[1:], total)
    four = _pair(two[:-2], two[2:], total)
    five = _pair(four[:-1], ids[4:], total)
    seen = np.bincount(five)
    again = np.flatnonzero((seen[five] > 1) & (owner[:-4] == owner[4:]))
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + GRAM, -1)
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=len(docs)).tolist()


def _count(texts: list[bytes]) -> dict[str, list[int]]:
    docs = [t.split() for t in texts]
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip(SPACES)]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": [len(d) for d in docs],
        "word_chars": [len(t.translate(None, SPACES).decode("utf-8", "surrogatepass")) for t in texts],
        "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
        "n_dup_lines": dup,
        "n_repeat_words": repeat_words(docs),
        "n_upper": [len(t) - len(t.translate(None, UPPER)) for t in texts],
        "n_marks": [len(t) - len(t.translate(None, MARKS)) for t in texts],
    }


def rule_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its counts; the text column stays for the caller to drop."""
    return with_text_columns(docs, text, COUNTS, lambda: _count)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def shares() -> dict[str, Column]:
    """What the forest splits on: shares, so that a long text is not an anomaly for its length. Repeats are left to
    the base rule, as a licence line or a quoted passage repeats in good texts too."""
    return {
        "mean_word": F.try_divide("word_chars", "n_words"),
        "symbol_share": F.try_divide("n_symbols", "word_chars"),
        "upper_share": F.try_divide("n_upper", "word_chars"),
        "mark_share": F.try_divide("n_marks", "word_chars"),
    }


@dataclass
class Forest:
    """Trees as arrays over nodes; a leaf has feature -1 and keeps the path length that it stands for."""

    psi: float
    feature: list[np.ndarray] = field(default_factory=list)
    split: list[np.ndarray] = field(default_factory=list)
    child: list[np.ndarray] = field(default_factory=list)  # the left one; the right one is next to it
    path: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score 2 ** (-mean path / expected path) of each row."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, child, path in zip(self.feature, self.split, self.child, self.path):
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= split[at]
                at = np.where(inner, child[at] + right, at)
            total += path[at]
        return 2.0 ** (-total / max(1, len(self.path)) / expected_path(self.psi))


def expected_path(n: float) -> float:
    """Mean path of a failed search in a binary tree of n rows."""
    return 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow_forest(samples: list[np.ndarray], seed: int, psi: int) -> Forest:
    """A tree for each sample of rows: a random feature that varies, a random split, until rows are alone or the
    depth reaches log2(psi)."""
    forest, limit = Forest(psi), math.ceil(math.log2(max(2, psi)))
    for k, sample in enumerate(samples):
        rng = np.random.default_rng([seed, k])
        feature, split, child, path = [-1], [0.0], [0], [0.0]
        todo = [(0, sample, 0)]
        while todo:
            node, x, depth = todo.pop()
            low, high = (x.min(0), x.max(0)) if len(x) else (np.zeros(1), np.zeros(1))
            vary = np.flatnonzero(high > low)
            if depth >= limit or len(x) <= 1 or not len(vary):
                path[node] = depth + (expected_path(len(x)) if len(x) > 2 else max(0.0, len(x) - 1.0))
                continue
            f = int(rng.choice(vary))
            cut = float(rng.uniform(low[f], high[f]))
            if cut <= low[f]:
                cut = float(high[f])
            feature[node], split[node], child[node] = f, cut, len(path)
            for part in (x[x[:, f] < cut], x[x[:, f] >= cut]):
                todo.append((len(path), part, depth + 1))
                for values, v in ((feature, -1), (split, 0.0), (child, 0), (path, 0.0)):
                    values.append(v)
        for kept, values in ((forest.feature, feature), (forest.split, split), (forest.child, child),
                             (forest.path, path)):
            kept.append(np.array(values))
    return forest


def fit(stats: DataFrame, key: str, p: ForestParams) -> Forest:
    """Grow the forest on documents that pass the base rule. Documents of equal shares are one row with their number; a
    document joins the sample if a hash of its id, counts and number among equal ones falls under ``trees * psi / rows``,
    and the hash also names its tree. Rows of one id, or of none, so fall apart by their counts, and equal rows are drawn
    by number: each of ``share * n`` places among them goes to a tree of its own. The driver gets that sample's four
    numbers only."""
    usable = stats.filter(~base_failed())
    n = usable.count()
    share = min(1.0, p.trees * p.psi / max(1, n))
    counts = [f.name for f in COUNTS]
    equal = usable.groupBy(key, *counts).agg(F.count(F.lit(1)).alias("rows"))
    # of the rows that are equal, the whole part of their share, and one more with the odds of the rest
    odds = F.pmod(F.xxhash64(F.lit(p.seed), F.col(key), *counts), F.lit(1 << 40)) / float(1 << 40)
    drawn = F.floor(F.col("rows") * share + odds).cast("int")
    each = equal.filter(drawn > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), drawn)))
    rows = (each.select(F.pmod(F.xxhash64(F.lit(p.seed + 1), F.col(key), *counts, "copy"), F.lit(p.trees)).alias("tree"),
                        *[e.cast("double").alias(c) for c, e in shares().items()])
            .orderBy("tree", *shares()).toPandas())
    samples = [g.drop(columns="tree").to_numpy(dtype=float) for _, g in rows.groupby("tree")]
    return grow_forest(samples, p.seed, max(2, round(np.mean([len(s) for s in samples])) if samples else 2))


def with_scores(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with anomaly_score in [0, 1]."""
    held = stats.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(a, b, c, d):
        import pandas as pd

        x = np.column_stack([s.to_numpy(dtype=float) for s in (a, b, c, d)])
        return pd.Series(held.value.score(np.nan_to_num(x)))

    return stats.withColumn("anomaly_score", score(*[e.cast("double") for e in shares().values()]))


def cut_off(scored: DataFrame, labels: DataFrame, key: str, p: ForestParams) -> float:
    """The score from which documents are rejected. ``labels``: (key, good 0/1), one row per key."""
    bin_of = F.least(F.floor(F.col("anomaly_score") * p.bins), F.lit(p.bins - 1))
    rows = (scored.filter(~base_failed()).select(key, "anomaly_score").join(labels, key)
            .groupBy(bin_of.alias("bin"), "good").count().collect())  # 2 * bins rows at most
    hist = np.zeros((2, p.bins))
    for r in rows:
        hist[int(r["good"]), int(r["bin"])] += r["count"]
    good, bad = hist[1].sum(), hist[0].sum()
    if not good or not bad:
        return math.inf
    lost, caught = (np.append(np.cumsum(h[::-1])[::-1], 0.0) for h in (hist[1], hist[0]))  # from bin k upwards
    allowed = np.flatnonzero(lost <= p.max_good_loss * good)
    gain = caught[allowed] / bad - lost[allowed] / good
    best = int(allowed[np.flatnonzero(gain >= gain.max() - 1e-12)[-1]])
    return best / p.bins


def apply_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                p: ForestParams = ForestParams()) -> DataFrame:
    """Key, counts, base_failed, anomaly_score and kept for every row of ``docs``. ``labels``: (key, quality 0/1);
    a key labelled more than once counts as good if any of its labels is."""
    stats, _ = staged(rule_counts(docs.select(key, text), text).drop(text), "rule-counts")
    good = (labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull())
            .groupBy(key).agg(F.max(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good")))
    scored = with_scores(stats, fit(stats, key, p))
    limit = cut_off(scored, good, key, p)
    failed = base_failed()
    return scored.select(key, *[f.name for f in COUNTS], failed.alias("base_failed"), "anomaly_score",
                         (~failed & (F.col("anomaly_score") < F.lit(limit))).alias("kept"))

"""Model scoring: feature matrix, stratified folds, boosted trees with
out-of-fold probabilities, exact ROC AUC / average precision, agreement.

Training uses Spark ML (distributed tree learning); the only driver loop is
over the three folds. Metrics are exact and computed with aggregates over the
distinct scores, never by collecting scores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanrisk.operators.boosting import spark_model, train
from spanrisk.operators.quantiles import medians, order_values
from spanrisk.operators.rank import global_rank, prefix_sums, rank_stage
from spanrisk.operators.score import severity_tier
from spanrisk.params import DEFAULT_MODEL, ML_FEATURE_COLS, ModelParams

KEY = ("STATE_CODE", "STRUCTURE_NUMBER")


def feature_matrix(df: DataFrame, label: str = "IS_POOR") -> DataFrame:
    """Structure key, the 12 non-circular model inputs and the 0/1 label."""
    return df.select(*KEY, *[F.col(c).cast("double").alias(c) for c in ML_FEATURE_COLS],
                     F.coalesce(F.col(label), F.lit(0)).cast("int").alias("label"))


def label_sufficiency(df: DataFrame, p: ModelParams = DEFAULT_MODEL, label: str = "IS_POOR") -> DataFrame:
    """One row: sample size, positives, prevalence and whether a model is trained."""
    return df.agg(F.count(F.lit(1)).alias("n_samples"),
                  F.sum(label).cast("bigint").alias("n_poor")).select(
        "n_samples", "n_poor",
        F.round(F.try_divide("n_poor", "n_samples"), 4).alias("prevalence"),
        (F.col("n_poor") > p.min_positives).alias("model_trained"))


def fold_hash(seed: int, key=KEY) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k) for k in key], F.lit(str(seed))))


def _first_place(n: Column, fold: int, n_folds: int) -> Column:
    """Where a fold begins in the hash order of ``n`` rows: n * fold / n_folds, rounded up."""
    return F.floor((n * fold + (n_folds - 1)) / n_folds)


def _fold_of(value: Column, starts: dict, label: str) -> Column:
    """How many of its label's starts a value has reached (None: never reached)."""
    fold = F.lit(0)
    for name, at in starts.items():
        reached = sum(((value >= F.lit(a)).cast("int") for a in at if a is not None), F.lit(0))
        fold = F.when(F.col(label).eqNullSafe(F.lit(name)), reached).otherwise(fold)
    return fold.cast("int")


def stratified_folds(df: DataFrame, label: str = "label", n_folds: int = 3, seed: int = 42, key=KEY) -> DataFrame:
    """Shuffled stratified folds: a label's rows in hash order (equal hashes by key) are dealt to the folds in turn, so
    that sizes differ by one at most and folds do not depend on the session. ``label`` has few values.

    Every row is numbered: rows move once, in full, into stored ranges of (label, hash), and a row's place is its number
    less that of its label's first row. Give it the columns that are needed."""
    order = [F.col(label).asc_nulls_first(), F.col("_hash").asc(), *[F.col(k).asc_nulls_last() for k in key],
             F.col("_row").asc()]  # the last one lets rows of one key be cut into ranges too
    rows = df.withColumns({"_hash": F.unhex(fold_hash(seed, key)), "_row": F.monotonically_increasing_id()})
    numbered = rank_stage(rows, order, "_rank", drop=("_hash", "_row")).table()
    first = F.lit(None).cast("bigint")
    for r in numbered.groupBy(label).agg(F.min("_rank").alias("first")).collect():
        first = F.when(F.col(label).eqNullSafe(F.lit(r[label])), F.lit(r["first"])).otherwise(first)
    return numbered.withColumn("fold", ((F.col("_rank") - first) % n_folds).cast("int")).drop("_rank")


def interval_folds(df: DataFrame, label: str = "label", n_folds: int = 3, seed: int = 42, key=KEY) -> DataFrame:
    """Shuffled stratified folds of wide rows: a label's rows in hash order are cut into ``n_folds`` intervals whose sizes
    differ by one at most. Where an interval begins is found by histograms of (label, hash) alone, after which a row's fold
    is a comparison of its own hash with literals: rows are neither shuffled nor sorted, and folds do not depend on the
    session. ``label`` has few values; ``df`` is read in every pass, so it is best a stored table.

    A hash that several rows share (rows of one key) may lie on a border; such rows alone are stored in a fixed order
    and cut by their place in it."""
    code = F.conv(F.substring(fold_hash(seed, key), 1, 13), 16, 10).cast("double")  # 52 bits: exact
    cuts = [lambda n, f=f: _first_place(n, f, n_folds) for f in range(1, n_folds)]
    coded = df.select(F.col(label), code.alias("_code"))
    starts = {g[0]: found[0] for g, found in order_values(coded, ["_code"], cuts, [label]).items()}
    out = df.withColumn("fold", _fold_of(code, starts, label))
    borders = [(g, v) for g, at in starts.items() for v in sorted({v for v in at if v is not None})]
    if not borders:
        return out
    is_label = [F.col(label).eqNullSafe(F.lit(g)) for g, _ in borders]
    c = F.col("_code")
    sizes = coded.agg(*[F.count_if(own & (c < v)) for own, (_, v) in zip(is_label, borders)],
                      *[F.count_if(own & (c == v)) for own, (_, v) in zip(is_label, borders)]).first()
    shared = [(g, v, sizes[i], sizes[len(borders) + i]) for i, (g, v) in enumerate(borders) if sizes[len(borders) + i] > 1]
    if not shared:
        return out
    return _cut_shared(df, out, code, label, n_folds, coded, shared)


def _cut_shared(df: DataFrame, out: DataFrame, code: Column, label: str, n_folds: int, coded: DataFrame,
                shared: list[tuple]) -> DataFrame:
    """``out`` with the rows of the ``shared`` hashes (label, hash, rows before, rows) cut by their place."""
    totals = {r[label]: r["n"] for r in coded.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = sorted(shared, key=lambda x: (x[0] is not None, x[0], x[1]))  # in the order that they are stored
    on_border, place, stored = F.lit(False), F.lit(None).cast("bigint"), 0
    for g, v, before, rows in shared:
        here = F.col(label).eqNullSafe(F.lit(g)) & (code == F.lit(v))
        on_border = on_border | here
        place = F.when(here, F.col("_rank") - 1 - stored + before).otherwise(place)
        stored += rows
    tied = df.filter(on_border).withColumns({"_code": code, "_row": F.monotonically_increasing_id()})
    ranked = global_rank(tied, [F.col(label).asc_nulls_first(), F.col("_code").asc(), F.col("_row").asc()], "_rank")
    starts = {g: [-(-totals[g] * f // n_folds) for f in range(1, n_folds)] for g, *_ in shared}
    cut = ranked.withColumn("fold", _fold_of(place, starts, label)).select(*out.columns)
    return out.filter(~F.coalesce(on_border, F.lit(False))).unionByName(cut)


def fill_values(fm: DataFrame, cols=ML_FEATURE_COLS) -> dict[str, float]:
    """Exact median of every input (even counts average the two middle values); 0 for one without any value."""
    found = medians(fm, cols).get((), [None] * len(cols))
    return {c: 0.0 if m is None else m for c, m in zip(cols, found)}


def _double(value: float) -> str:
    return f"{value!r}D" if math.isfinite(value) else f"double('{value!r}')"


def gbt_pipeline(fills: dict[str, float], p: ModelParams = DEFAULT_MODEL):
    """Median fill (``fills``), assembly and boosted trees; every stage has Spark ML persistence."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import SQLTransformer, VectorAssembler

    filled = ", ".join(f"CASE WHEN `{c}` IS NULL OR isnan(`{c}`) THEN {_double(m)} ELSE CAST(`{c}` AS DOUBLE) END "
                       f"AS `{c}__imp`" for c, m in fills.items())
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{c}__imp" for c in fills], outputCol="features"),
        GBTClassifier(featuresCol="features", labelCol="label", maxIter=p.n_trees, maxDepth=p.max_depth,
                      stepSize=p.learning_rate, subsamplingRate=p.subsample, seed=p.seed),
    ])


def impute_median(fm: DataFrame, cols=ML_FEATURE_COLS) -> DataFrame:
    """Median fill of the model inputs where they are null or NaN."""
    fills = fill_values(fm, cols)
    return fm.withColumns({c: F.when(F.col(c).isNull() | F.isnan(c), F.lit(m)).otherwise(F.col(c))
                           for c, m in fills.items()})


def _p1(c: str = "probability") -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(c))[1]


#: Training rows of fits that run at once: Spark ML keeps some 260 bytes for a row of 12 inputs, so these take about 5 GB;
#: what does not fit into memory is read from disk in every pass.
ROWS_AT_ONCE = 20_000_000


def fits_at_once(rows: int, wanted: int) -> int:
    """How many of ``wanted`` fits of ``rows`` rows each may run side by side. Small ones overlap their scheduling; a large
    one keeps all cores busy by itself and needs the memory."""
    return max(1, min(wanted, ROWS_AT_ONCE // max(rows, 1)))


def fit_gbt(fm: DataFrame, p: ModelParams = DEFAULT_MODEL, cols=ML_FEATURE_COLS):
    """The fitted ``gbt_pipeline``. Its trees are trained over blocks of binned rows (``boosting``); the stages and the
    model are Spark ML's."""
    from pyspark.ml import PipelineModel

    fills = fill_values(fm, cols)
    *before, classifier = gbt_pipeline(fills, p).getStages()
    trees, thresholds = train(fm, list(cols), fills, p.n_trees, p.max_depth, p.learning_rate, p.subsample, p.seed)
    return PipelineModel(stages=[*before, spark_model(classifier, trees, thresholds, fm.sparkSession)])


def oof_probability(df: DataFrame, p: ModelParams = DEFAULT_MODEL, keep: list[str] | None = None) -> DataFrame:
    """Out-of-fold probability per structure: fit on the other folds, score the held-out one.

    ``df`` needs the model inputs and ``label``, and is best a stored table: folds are comparisons on read, so every fit
    scans the label, the key and its inputs only. The held-out folds keep the ``keep`` columns (default: key, label), so
    no join is needed afterwards."""
    from concurrent.futures import ThreadPoolExecutor

    keep = list(keep) if keep is not None else [*KEY, "label"]
    folded = interval_folds(df, "label", p.n_folds, p.seed)
    inputs = folded.select(*ML_FEATURE_COLS, "label", "fold")
    rows = df.count() * (p.n_folds - 1) // p.n_folds

    def fit_fold(f: int) -> DataFrame:
        model = fit_gbt(inputs.filter(F.col("fold") != f).drop("fold"), p)
        held = model.transform(folded.filter(F.col("fold") == f))
        return held.select(*keep, "fold", _p1().alias("ML_PROBA"))

    # the fold fits are independent Spark jobs: submit them concurrently so the
    # per-iteration scheduling of one fit overlaps the others, where the rows of all fit into memory
    with ThreadPoolExecutor(max_workers=fits_at_once(rows, min(p.n_folds, p.concurrent_fits))) as pool:
        parts = list(pool.map(fit_fold, range(p.n_folds)))
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out


def gbt_importances(model, cols=ML_FEATURE_COLS) -> list[tuple[str, float]]:
    gbt = model.stages[-1]
    return [(c, float(v)) for c, v in zip(cols, gbt.featureImportances.toArray())]


def curve_sums(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score (descending): positives, negatives and their running totals."""
    g = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return prefix_sums(g, [F.col("score").desc()], ["pos", "neg"])


def ranking_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact ROC AUC (ties count one half) and step-wise average precision, one row."""
    c = curve_sums(df, score, label)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    cpos, cneg = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    agg = c.agg(F.sum(pos).alias("P"), F.sum(neg).alias("N"),
                F.sum(pos * cneg).alias("A"), F.sum(pos * neg).alias("B"),
                F.sum(F.try_divide(pos * cpos, cpos + cneg)).alias("C"))
    return agg.select(
        F.try_divide(F.col("N") * F.col("P") - F.col("A") + 0.5 * F.col("B"), F.col("P") * F.col("N"))
        .alias("roc_auc"),
        F.try_divide("C", "P").alias("average_precision"),
        (F.col("P") + F.col("N")).cast("bigint").alias("n_samples"),
        F.col("P").cast("bigint").alias("n_poor"))


def model_report(df: DataFrame, score: str = "ML_PROBA", label: str = "IS_POOR") -> DataFrame:
    m = ranking_metrics(df, score, label)
    return m.select(F.round("roc_auc", 4).alias("gbt_cv_auc"), F.round("average_precision", 4).alias("gbt_cv_ap"),
                    "n_samples", "n_poor", F.round(F.try_divide("n_poor", "n_samples"), 4).alias("prevalence"))


NOTE_FEW_LABELS = "ML not trained due to insufficient labels"
NOTE_SWITCHED_OFF = "ML not trained: switched off"


def untrained_report(df: DataFrame, note: str, label: str = "label") -> DataFrame:
    """The report of a run without a model: why there is none, and the rows and poor ones that there were."""
    return df.agg(F.lit(note).alias("note"), F.count(F.lit(1)).alias("n_samples"),
                  F.count_if(F.col(label) > 0).alias("n_poor"))


def component_agreement(df: DataFrame, a: str = "SDI", b: str = "ML_PROBA") -> DataFrame:
    """Index vs probability: Pearson r, exact tier agreement, High+ overlap counts."""
    ta, tb = severity_tier(F.col(a)), severity_tier(F.col(b))
    hi_a, hi_b = F.col(a) >= 0.5, F.col(b) >= 0.5
    return df.agg(
        F.corr(a, b).alias("pearson_r"),
        F.try_divide(100.0 * F.count_if(ta == tb), F.count(F.lit(1))).alias("tier_agreement_pct"),
        F.count_if(hi_a & hi_b).alias("flagged_both"),
        F.count_if(hi_a & ~hi_b).alias("flagged_index_only"),
        F.count_if(~hi_a & hi_b).alias("flagged_model_only"))

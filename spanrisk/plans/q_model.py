"""Queries for scoring and the model.

Oracle-checked queries use the deterministic proxy probability (FIXTURES §B);
the quality of the boosted trees is asserted in tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanrisk.operators import model as M
from spanrisk.params import ML_FEATURE_COLS
from spanrisk.plans import oracle_base as O
from spanrisk.plans import pipeline as P
from spanrisk.plans.catalog import query
from spanrisk.plans.common import dround, project, rounded
from spanrisk.session import scratch_path

_K = "STATE_CODE, STRUCTURE_NUMBER"
_ML = ", ".join(f"round({c}, 6) AS {c}" if c != "IS_CLOSED" else "CAST(IS_CLOSED AS DOUBLE) AS IS_CLOSED"
                for c in ML_FEATURE_COLS)


@query("deficiency_index", "model", sql=f"""{O.with_stage('sc')}
SELECT {_K}, round(SDI, 6) AS SDI FROM sc""")
def q_deficiency_index(spark, sf):
    return project(P.scored(spark, sf), ["SDI"])


@query("composite_score", "model", sql=f"""{O.with_stage('sc')}
SELECT {_K}, round(SDI, 6) AS SDI, round(ML_PROBA, 6) AS ML_PROBA, round(RISK_SCORE, 6) AS RISK_SCORE FROM sc""")
def q_composite_score(spark, sf):
    return project(P.scored(spark, sf), ["SDI", "ML_PROBA", "RISK_SCORE"])


@query("feature_matrix", "model", sql=f"""{O.with_stage('ft')}
SELECT {_K}, {_ML}, CAST(coalesce(IS_POOR, 0) AS INTEGER) AS label FROM ft""")
def q_feature_matrix(spark, sf):
    return rounded(M.feature_matrix(P.features(spark, sf)))


_GAPS = {c: 7 + k for k, c in enumerate(ML_FEATURE_COLS)}  # every 7th, 8th, ... row by its hash loses that input
_GAP_ROW = "('0x' || substring(md5(concat_ws('|', STATE_CODE, STRUCTURE_NUMBER, '42')), 1, 8))::BIGINT"
_GAP_VALUES = ", ".join(f"CASE WHEN {_GAP_ROW} % {n} = 0 THEN NULL ELSE CAST({c} AS DOUBLE) END AS {c}"
                        for c, n in _GAPS.items())
_MEDIANS = ", ".join(f"median({c}) AS {c}" for c in _GAPS)


@query("impute_median", "model", sql=f"""{O.with_stage('ft')},
gp AS (SELECT {_K}, {_GAP_VALUES}, CAST(coalesce(IS_POOR, 0) AS INTEGER) AS label FROM ft),
md AS (SELECT {_MEDIANS} FROM gp)
SELECT {_K}, {", ".join(f"round(coalesce(gp.{c}, md.{c}), 6) AS {c}" for c in _GAPS)}, label FROM gp, md""")
def q_impute_median(spark, sf):
    """Median fill of inputs with gaps (a fixed share of each input, by a hash of the key)."""
    row = F.conv(F.substring(M.fold_hash(42), 1, 8), 16, 10).cast("bigint")
    fm = P.model_inputs(spark, sf)
    return rounded(M.impute_median(fm.withColumns({c: F.when(row % n != 0, F.col(c)) for c, n in _GAPS.items()})))


@query("label_sufficiency", "model", sql=f"""{O.with_stage('ft')}
SELECT count(*) AS n_samples, CAST(sum(IS_POOR) AS BIGINT) AS n_poor,
 round(sum(IS_POOR) / count(*), 4) AS prevalence, sum(IS_POOR) > 100 AS model_trained FROM ft""")
def q_label_sufficiency(spark, sf):
    return M.label_sufficiency(P.features(spark, sf))


_FOLDS_SQL = f"""h AS (SELECT {_K}, CAST(coalesce(IS_POOR, 0) AS INTEGER) AS label,
  md5(concat_ws('|', STATE_CODE, STRUCTURE_NUMBER, '42')) AS hh FROM ft),
fd AS (SELECT {_K}, label, CAST((row_number() OVER (PARTITION BY label ORDER BY hh, STATE_CODE, STRUCTURE_NUMBER) - 1) * 3
  // count(*) OVER (PARTITION BY label) AS INTEGER) AS fold FROM h)"""


_DEALT_SQL = f"""h AS (SELECT {_K}, CAST(coalesce(IS_POOR, 0) AS INTEGER) AS label,
  md5(concat_ws('|', STATE_CODE, STRUCTURE_NUMBER, '42')) AS hh FROM ft),
fd AS (SELECT {_K}, label, CAST((row_number() OVER (PARTITION BY label ORDER BY hh, STATE_CODE, STRUCTURE_NUMBER) - 1) % 3
  AS INTEGER) AS fold FROM h)"""


@query("stratified_folds", "model", sql=f"""{O.with_stage('ft', _DEALT_SQL)}
SELECT {_K}, label, fold FROM fd""")
def q_stratified_folds(spark, sf):
    fm = M.feature_matrix(P.features(spark, sf)).select(*M.KEY, "label")  # what is dealt moves, so no features
    return M.stratified_folds(fm, "label", 3, 42).select("STATE_CODE", "STRUCTURE_NUMBER", "label", "fold")


_CURVE = """g AS (SELECT ML_PROBA AS score, CAST(count_if(IS_POOR = 1) AS DOUBLE) AS pos,
   CAST(count_if(IS_POOR = 0) AS DOUBLE) AS neg FROM sc GROUP BY ML_PROBA),
cc AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
   sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM g),
m AS (SELECT sum(pos) AS P, sum(neg) AS N, sum(pos * ((SELECT sum(neg) FROM g) - cum_neg + 0.5E0 * neg)) AS U,
   sum(pos * cum_pos / (cum_pos + cum_neg)) AS C FROM cc)"""


@query("roc_auc", "model", sql=f"""{O.with_stage('sc', _CURVE)}
SELECT round(U / (P * N), 6) AS roc_auc FROM m""")
def q_roc_auc(spark, sf):
    m = M.ranking_metrics(P.scored(spark, sf), "ML_PROBA", "IS_POOR")
    return m.select(dround("roc_auc", 6).alias("roc_auc"))


@query("average_precision", "model", sql=f"""{O.with_stage('sc', _CURVE)}
SELECT round(C / P, 6) AS average_precision FROM m""")
def q_average_precision(spark, sf):
    m = M.ranking_metrics(P.scored(spark, sf), "ML_PROBA", "IS_POOR")
    return m.select(dround("average_precision", 6).alias("average_precision"))


@query("model_report", "model", sql=f"""{O.with_stage('sc', _CURVE)}
SELECT round(U / (P * N), 4) AS gbt_cv_auc, round(C / P, 4) AS gbt_cv_ap, CAST(P + N AS BIGINT) AS n_samples,
 CAST(P AS BIGINT) AS n_poor, round(P / (P + N), 4) AS prevalence FROM m""")
def q_model_report(spark, sf):
    return M.model_report(P.scored(spark, sf), "ML_PROBA", "IS_POOR")


def _tier_sql(c: str) -> str:
    return (f"CASE WHEN {c} >= 0.75E0 THEN 'Critical' WHEN {c} >= 0.5E0 THEN 'High' "
            f"WHEN {c} >= 0.25E0 THEN 'Medium' ELSE 'Low' END")


@query("component_agreement", "model", sql=f"""{O.with_stage('sc')}
SELECT round(corr(SDI, ML_PROBA), 6) AS pearson_r,
 round(100.0E0 * count_if({_tier_sql('SDI')} = {_tier_sql('ML_PROBA')}) / count(*), 6) AS tier_agreement_pct,
 count_if(SDI >= 0.5E0 AND ML_PROBA >= 0.5E0) AS flagged_both,
 count_if(SDI >= 0.5E0 AND NOT ML_PROBA >= 0.5E0) AS flagged_index_only,
 count_if(NOT SDI >= 0.5E0 AND ML_PROBA >= 0.5E0) AS flagged_model_only FROM sc""")
def q_component_agreement(spark, sf):
    return rounded(M.component_agreement(P.scored(spark, sf)))


# ---- boosted trees: their structure and ranges have SQL, their quality is asserted in tests ----

@query("fit_gbt", "model", sql=f"SELECT 100 AS n_trees, {len(ML_FEATURE_COLS)} AS n_inputs, true AS importances_sum_to_one")
def q_fit_gbt(spark, sf):
    """Fit the published configuration on all rows; one row describing the model."""
    fm = P.model_inputs(spark, sf)
    model = M.fit_gbt(fm)
    rows = M.gbt_importances(model)
    total = sum(v for _, v in rows)
    return spark.createDataFrame([(model.stages[-1].getNumTrees, len(rows), abs(total - 1) < 1e-6)],
                                 "n_trees int, n_inputs int, importances_sum_to_one boolean")


@query("oof_probability", "model", sql=f"""{O.with_stage('ft', _FOLDS_SQL)}
SELECT {_K}, label, fold, true AS in_range FROM fd""")
def q_oof_probability(spark, sf):
    """Out-of-fold probability for every structure (3 stratified folds)."""
    oof = M.oof_probability(P.model_inputs(spark, sf))
    return oof.select("STATE_CODE", "STRUCTURE_NUMBER", "label", "fold",
                      F.coalesce(F.col("ML_PROBA").between(0.0, 1.0), F.lit(False)).alias("in_range"))


@query("save_model", "sources", sql="SELECT CAST(0 AS BIGINT) AS rows_that_differ")
def q_save_model(spark, sf):
    """Fit, persist with Spark ML persistence, load back; rows that the loaded model scores differently."""
    from pyspark.ml import PipelineModel

    fm = P.model_inputs(spark, sf)
    model = M.fit_gbt(fm)
    path = scratch_path(spark, "gbt_model")
    model.write().overwrite().save(path)
    both = PipelineModel.load(path).transform(model.transform(fm).select(
        *ML_FEATURE_COLS, M._p1().alias("p")))
    return both.agg(F.count_if(~F.col("p").eqNullSafe(M._p1())).alias("rows_that_differ"))

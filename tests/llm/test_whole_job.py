"""Operators use all rows, not a part of them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from spanrisk.llm import cotrain as Q
from spanrisk.llm import html_extract as X
from spanrisk.llm import simhash as H


def _two_kinds(spark, n=6000):
    """Texts of two kinds, the first 80 labelled; 29 unlabelled rows have a source of their own."""
    docs = spark.range(n).selectExpr(
        "id AS doc_id", "IF(id % 2 = 0, 'fine calm prose', 'junk spam noise') AS text", "'en' AS lang",
        "IF(id >= 80 AND id % 200 = 1, 'rare', IF(id < 80, 'seen', concat('s', id % 2))) AS source", "15L AS n_chars")
    labels = spark.range(80).selectExpr("id AS doc_id", "CAST(id % 2 = 0 AS int) AS quality", "0 AS toxic")
    return docs, labels


def test_pseudo_labels_cover_all_rows(spark):
    docs, labels = _two_kinds(spark)
    views = Q.fit(docs, labels, p=Q.CotrainParams(sure=0.8, min_z=2.0))
    assert Q._number(b"source=rare") in views.meta.ids  # 29 rows of 5,920
    assert views.given[0][0] == 5920


def test_stored_rows_train_like_rows_in_memory(spark):
    docs, labels = _two_kinds(spark, 900)
    p = Q.CotrainParams(sure=0.8)
    good = labels.selectExpr("doc_id", "quality AS good")
    rows = Q._features(docs, good, "doc_id", "text", ["source", "lang", "n_chars:size"], p)
    there = Q.train(Q.Stored(rows.repartition(3)), p)
    here = Q.train(Q.Local(Q._part(rows.toArrow().combine_chunks().to_batches()[0])), p)
    assert here.given == there.given
    for a, b in ((here.text, there.text), (here.meta, there.meta)):
        assert a.ids.tolist() == b.ids.tolist()
        np.testing.assert_allclose(a.weight, b.weight, atol=1e-6)


def test_labels_are_the_same_held_or_joined(spark):
    docs, labels = _two_kinds(spark, 900)
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 50 != 3, F.col("doc_id")))
    good = labels.selectExpr("doc_id", "quality AS good").unionAll(spark.sql("SELECT -5L, 1"))
    p, meta = Q.CotrainParams(), ["source", "lang"]
    for d, lab in ((docs, good), (docs.withColumn("doc_id", F.concat(F.lit("k"), "doc_id")),
                                  good.withColumn("doc_id", F.concat(F.lit("k"), "doc_id")))):
        held, joined = (sorted(map(tuple, Q._features(d, lab, "doc_id", "text", meta, p, limit).collect()), key=repr)
                        for limit in (Q.LABELS_HELD, 0))
        assert held == joined and len(held) == 900 and sum(r[1] >= 0 for r in held) == 78


def test_stored_features_score_like_texts(spark):
    docs, labels = _two_kinds(spark, 900)
    docs = docs.unionAll(docs.filter("doc_id < 3")).withColumn("text", F.when(F.col("doc_id") % 90 != 7, F.col("text")))
    cols = ("doc_id", "text_score", "meta_score", "score", "kept")
    a, b = (sorted(map(tuple, f(docs, labels).select(*cols).collect())) for f in (Q.classify, Q.classify_keys))
    assert len(a) == len(b) == 903 and [(x[0], x[4]) for x in a] == [(x[0], x[4]) for x in b]
    np.testing.assert_allclose([x[1:4] for x in a], [x[1:4] for x in b], atol=1e-9)


def test_each_view_labels_its_surest_rows():
    """Neither view reaches ``sure``; the metadata view has some signal, and its surest rows teach the text view."""
    rng = np.random.default_rng(7)
    n = 6000
    kind = rng.random(n) < 0.5
    meta = Q.Rows.of([[2 + int(k != (rng.random() < 0.2))] for k in kind])
    text = Q.Rows.of([[12 + int(k != (rng.random() < 0.3))] for k in kind])
    blind = Q.Rows.of([[22 + int(rng.random() < 0.5)] for _ in kind])
    y = np.where(np.arange(n) < 2000, kind, -1).astype(int)
    done = Q.cotrain(text, meta, y, Q.CotrainParams(min_z=2.0))
    assert all(a > 0 and b > 0 for a, b in done.given)
    assert all(0.2 < x < 0.9 for lifts in done.lifts for sides in lifts for x in sides)
    none = Q.cotrain(text, blind, y, Q.CotrainParams(min_z=2.0))
    assert all(x < 0.2 for lifts in none.lifts for x in lifts[1])
    assert all(steps <= Q.CotrainParams().steps and grad < 1e-2 for fit in done.fits for steps, grad in fit)


def test_mixing_draws_by_label(spark, tmp_path):
    """Equal prose: documents labelled good are drawn more often than those labelled bad."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "'plain prose of one size' AS text", "'en' AS lang",
                                        "concat('s', id % 2) AS source", "24L AS n_chars")
    spark.range(4000).selectExpr("id AS doc_id", "CAST(id % 4 < 2 AS int) AS quality").write.parquet(
        f"{tmp_path}/labels.parquet")
    drawn = P.source_mixing(spark, docs.unionAll(docs.filter("doc_id = 1")), str(tmp_path)).filter("source = 's1'")
    good = drawn.filter("doc_id % 4 < 2").count()
    assert good > 1.5 * (drawn.count() - good)
    assert drawn.filter("doc_id = 1").count() % 2 == 0  # repeated rows are drawn alike


PROSE = "<h2>Head</h2><p>Long prose, with stops. And more of it, here.</p><p>It goes on, and on, to the end.</p>"
PLAIN = "Head\nLong prose, with stops. And more of it, here.\nIt goes on, and on, to the end."


@pytest.mark.parametrize("page", [
    f"<div id=content>{PROSE}</div><div><article class=card><p>Read it</p></article></div>",
    f"<article>{PROSE}</article><div><p>Outside, and not part of it.</p></div>"])
def test_teasers_do_not_replace_the_text(page):
    assert X.main_text(page).startswith(PLAIN) and "Outside" not in X.main_text(page)


def test_ratios_decide_inside_an_article():
    text = "Long prose, with stops. " * 10
    deep = "<div>" * 8 + "<span>ok</span>" + "</div>" * 8
    assert X.main_text(f"<article><h1>T</h1><p>{text}</p>{deep}</article>") == f"T\n{text.strip()}"


@pytest.mark.parametrize("page", [
    f"<div class='content-sidebar-wrap'><article>{PROSE}</article><div class=sidebar>Links, more</div></div>",
    f"<div class='layout sidebar-right'><div>{PROSE}</div><div class=ads>Buy, now</div></div>",
    f"<form action=x><div>{PROSE}</div></form>",
    f"<article><div class='entry-header'>{PROSE[:13]}</div>{PROSE[13:]}</article>"])
def test_names_around_the_text_do_not_hide_it(page):
    assert X.main_text(page) == PLAIN


def test_components_of_one_key_leave_a_row_each(spark):
    """Two texts share key 7; the first has a copy under 3, the other one is alone."""
    a, b = "the quick brown fox jumps over the lazy dog " * 5, "entirely other words stand in this second text " * 5
    for rows in ([(7, a), (3, a), (7, b)], [(7, b), (7, a), (3, a)], [(7, a), (7, b), (7, b)]):
        got = H.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert sorted(r["text"] for r in got.collect()) == sorted([a, b])


def test_calibration_covers_all_held_out_rows(spark):
    docs, _ = _two_kinds(spark, 16000)
    labels = spark.range(16000).selectExpr("id AS doc_id", "CAST(id % 2 = 0 AS int) AS good")
    p = Q.CotrainParams()
    rows = Q._features(docs, labels, "doc_id", "text", ["source", "lang", "n_chars:size"], p)
    blank = [Q.Linear(), Q.Linear()]
    n = Q.Stored(rows).sums(lambda part: part.cells(blank, p))[2][:, 0].sum()
    assert n == rows.filter("held").count() > 16000 / p.holdout * 0.9  # at most 2,500 when the fit took 10,000 rows


def test_cut_off_keeps_good_rows():
    at, truth = np.array([-900, -800, 500, 900]), np.array([0, 1, 0, 1])
    p = Q.CotrainParams()
    inside = Q.choose_cut(at, truth, np.array([50, 1, 30, 999]), p)  # one good row in a thousand may go
    assert 500 / p.cut_bins < np.log(inside / (1 - inside)) < 900 / p.cut_bins
    beyond = Q.choose_cut(at, truth, np.array([50, 10, 30, 990]), p)
    assert -900 / p.cut_bins < np.log(beyond / (1 - beyond)) < -800 / p.cut_bins

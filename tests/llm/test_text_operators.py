"""Decontamination, HTML extraction, rules, classifier and token counts against plain Python."""

import re
from collections import Counter

import numpy as np
import pytest

from spanrisk.llm import cotrain as Q
from spanrisk.llm import decontaminate as D
from spanrisk.llm import html_extract as X
from spanrisk.llm import rule_forest as R
from spanrisk.llm import token_count as K
from tests.conftest import SF_MID
from tests.llm import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "tiny item"), (3, None), (4, "..."),
         (5, "two three four five six seven eight nine ten eleven twelve"), (None, "no id"), (2, "item of two"),
         (6, "same text for all of these rows to be linked same text")]


def test_hits_against_windows(spark):
    rows = cases.texts() + [(900, "Zero ONE two, three four five six seven eight nine ten eleven twelve. Tiny item!",
                             "en", "s", 1), (901, "item of two tiny items tiny item", "en", "s", 1),
                            (902, "There is no ID here", "en", "s", 1)]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    windows = []
    for item, text in ITEMS:
        w = plain_words(text)
        if w:
            windows += [(item, w[i:i + 10]) for i in range(max(1, len(w) - 9))]
    want = Counter()
    for key, text, *_ in rows:
        w, hit, found = plain_words(text), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
        want[key, len(w), len(hit), tuple(sorted(x for x in found if x is not None))] += 1
    for block in (100_000, 12):
        got = D.find_overlaps(cases.docs(spark, rows, clash=True), items, block_words=block).select(
            "doc_id", "n_words", D.n_hit().alias("n"), "items").collect()
        assert Counter((r[0], r[1], r[2], tuple(r[3])) for r in got) == want


def test_cut_removes_hits_only(spark):
    items = spark.createDataFrame([(1, "Alpha BETA gamma")], "item_id bigint, text string")
    rows = [(1, "Before: alpha, Beta gamma! After it", "en", "s", 1), (2, "alpha beta gamma", "en", "s", 1),
            (3, "clean Text.", "en", "s", 1), (4, None, None, None, None)]
    got = {r["doc_id"]: r["text"] for r in D.decontaminate(cases.docs(spark, rows), items).collect()}
    assert got == {1: "Before: ! After it", 3: "clean Text.", 4: None}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.find_overlaps(cases.docs(spark), none).filter("size(items) > 0").count() == 0
    assert D.find_overlaps(cases.docs(spark, []), none).count() == 0
    assert R.apply_rules(cases.docs(spark, []), cases.labels(spark, [])).count() == 0
    assert Q.classify(cases.docs(spark, []), cases.labels(spark, [])).count() == 0
    assert K.count_tokens(cases.docs(spark, [])).count() == 0


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>
<div class="cookie-notice"><p>We use cookies, dear reader.</p></div>
<div class="content"><h2>The  title</h2><p>Long paragraph, with text; and more.
It goes on, and on.<p>Sho<b>rt</b>.<ul><li>one &lt;item&gt;, ok<li>two &amp;amp;</ul></div>
<div id="side-bar"><p>Links, and more links, here.</p></div>
<section id="comments"><article class="comment"><p>Nice, very nice, indeed.</p></article></section>
<script>if (a<b) "</div>"</script><form><p>Name, please: <input></p></form><footer>(c) 2020, us.</footer></body></html>"""


def test_extraction_without_article():
    assert X.main_text(PAGE) == ("The title\nLong paragraph, with text; and more. It goes on, and on.\nShort.\n"
                                 "one <item>, ok\ntwo &amp;")


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain <b>te</b>xt &amp; more", "plain text & more"), ("<p>a<!-- x <p>q</p>", "a"),
    ("<article><h1>T</h1><div class=ad>Buy, now</div><p>x</p></article><p>outside, long, text.</p>", "T\nx"),
    ("<title>t</title><main><p>a<br>b</p><aside>c</aside></main>", "a b"), ("<nav><p>menu</p></nav>", ""),
    ("<article><p>a<p", "a"), ("<style>x", "")])
def test_extraction(page, text):
    assert X.main_text(page) == text


def test_pages_frame(spark):
    rows = [(1, "u", None, "c"), (2, "u", "<p>Ünï</p>", "c"), (2, "u", "<p>Ünï</p>", "c"), (3, None, "", "c")]
    got = X.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"))
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got.collect()) == [
        (1, "", 0), (2, "Ünï", 3), (2, "Ünï", 3), (3, "", 0)]


def plain_counts(text):
    text = text or ""
    w = TOKEN.findall(text)
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = {k for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if TOKEN.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_rule_counts(spark):
    got = R.apply_rules(cases.docs(spark, clash=True), cases.labels(spark, [])).collect()
    want = Counter()
    for key, text, *_ in cases.texts():
        c = plain_counts(text)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        want[(key, *c, failed, not failed)] += 1  # no labels: the base rule alone decides
    assert Counter((r["doc_id"], *(r[f.name] for f in R.COUNTS[:5]), r["base_failed"], r["kept"])
                   for r in got) == want


def test_forest_isolates():
    rng = np.random.default_rng(3)
    usual = rng.normal(0, 1, (4000, 4))
    forest = R.grow_forest(list(usual.reshape(50, 80, 4)), 7, 80)
    odd = forest.score(np.full((1, 4), 9.0))[0]
    assert odd > np.quantile(forest.score(usual), 0.999)


def test_rules_keep_good_rows(spark):
    d = spark.read.parquet(f"{SF_MID}/documents.parquet")
    lab = spark.read.parquet(f"{SF_MID}/labels.parquet")
    got = R.apply_rules(d, lab).filter("not base_failed").join(lab, "doc_id")
    lost = got.filter("quality = 1 and not kept").count()
    assert lost <= 0.01 * got.filter("quality = 1").count()
    assert got.filter("quality = 0 and not kept").count() >= 0.5 * got.filter("quality = 0").count()


def test_forest_sample_does_not_hang_on_ids(spark):
    """Null, equal and repeated ids: as many rows are drawn as of distinct ids, and equal rows by their number."""
    texts = [" ".join(f"w{(i * 7 + j) % (5 + i % 40)}" for j in range(20 + i % 60)) for i in range(600)]
    p = R.ForestParams(trees=4, psi=64)
    for ids in ([None] * 600, [5] * 600, list(range(600))):
        docs = cases.docs(spark, [(i, t, "en", "s", 1) for i, t in zip(ids, texts)])
        forest = R.fit(R.rule_counts(docs.select("doc_id", "text"), "text"), "doc_id", p)
        assert len(forest.path) == 4 and all(len(x) > 20 for x in forest.path)
    one = cases.docs(spark, [(None, "w " * 3 + " ".join(f"x{j}" for j in range(30)), "en", "s", 1)] * 600)
    assert len(R.fit(R.rule_counts(one.select("doc_id", "text"), "text"), "doc_id", p).path) == 4


def test_classifier_on_unseen_rows(spark):
    big = SF_MID.replace("sf0.01", "sf0.1")
    d = spark.read.parquet(f"{big}/documents.parquet")
    lab = spark.read.parquet(f"{big}/labels.parquet")
    views = Q.fit(d, lab.filter("doc_id % 2 = 0"))
    got = Q.score(d, views).join(lab.filter("doc_id % 2 = 1"), "doc_id").select(
        "kept", "quality", "toxic").toPandas()
    good = (got.quality == 1) & (got.toxic == 0)
    assert got.kept[good].mean() > 0.98
    assert got.kept[~good].mean() < 0.2


def test_classifier_edge_rows(spark):
    d = cases.docs(spark, clash=True)
    got = Q.classify(d, cases.labels(spark, []))
    assert got.filter("score = 0.5 and kept").count() == len(cases.texts())
    lab = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(60)] + [(1, None, None), (None, 1, 0), (2, 0, 0)]
    got = Q.classify(d, cases.labels(spark, lab))
    assert got.count() == len(cases.texts())
    assert got.filter("score is null or kept is null").count() == 0


def test_pseudo_labels_travel():
    """The text view is certain of the pool; the metadata view learns its feature from those pseudo-labels."""
    kind = [k // 4 % 2 for k in range(400)]
    text = Q.Rows.of([[c + 1] for c in kind])
    meta = Q.Rows.of([[kind[k] + 11] if k >= 40 else [20] for k in range(400)])
    y = np.array([kind[k] if k < 40 else -1 for k in range(400)])
    p = Q.CotrainParams(sure=0.8)
    assert len(Q.cotrain(text, meta, y, p).meta.ids) == 2
    assert len(Q.cotrain(text, meta, y, Q.CotrainParams(rounds=0)).meta.ids) == 0


def plain_tokens(word, vocab):
    s = K.MARK + word
    best = [(0.0, 0)]
    for i in range(1, len(s) + 1):
        raw = len(s[i - 1].encode())
        options = [(best[i - 1][0] + raw * vocab.byte_score, -(-best[i - 1][1] + raw))]
        options += [(best[j][0] + vocab.score[s[j:i]], best[j][1] - 1) for j in range(i) if s[j:i] in vocab.score]
        best.append(max(options))
    return -best[-1][1]


def test_token_counts(spark):
    vocab = K.load_vocabulary()
    want = Counter()
    for key, text, *_ in cases.texts():
        w = TOKEN.findall(text or "")
        n = Counter(w)
        want[key, len(w), sum(plain_tokens(x, vocab) * k for x, k in n.items())] += 1
    for limit in (K.MAX_NODES, 20):
        got = K.count_tokens(cases.docs(spark, clash=True), max_nodes=limit).collect()
        assert Counter((r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in got) == want


def test_prefix_scored_once():
    trie = K.CountingTrie(K.vocabulary({"▁": -1.0, "a": -1.0, "ab": -1.5, "c": -2.0}))
    assert [trie[w] for w in (b"abc", b"abd", b"ab")] == [3, 3, 2]
    assert trie.scored == 5  # marker, a, b, c, d

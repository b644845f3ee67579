"""Registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrisk.llm import chat_format as C
from spanrisk.llm import cotrain as Q
from spanrisk.llm import decontaminate as D
from spanrisk.llm import html_extract as X
from spanrisk.llm import mix as M
from spanrisk.llm import prefix_trie as P
from spanrisk.llm import resample as I
from spanrisk.llm import rule_forest as R
from spanrisk.llm import shard as S
from spanrisk.llm import simhash as H
from spanrisk.llm import suffix_dedup as U
from spanrisk.llm import token_count as K
from spanrisk.llm import warc as W
from spanrisk.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    marked = D.find_overlaps(table(spark, sf_dir, "documents", "doc_id", "text"),
                             table(spark, sf_dir, "benchmark", "item_id", "text"))
    return marked.select("doc_id", "n_words", D.n_hit().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                         D.item_digest().alias("items_sha256"), (D.n_hit() > 0).alias("contaminated"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return X.extract(table(spark, sf_dir, "pages", "page_id", "url", "html")).drop("html")


def op3_rule_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and the isolation forest's verdict on every document."""
    return R.apply_rules(table(spark, sf_dir, "documents", "doc_id", "text"),
                         table(spark, sf_dir, "labels", "doc_id", "quality"))


def op4_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both views' scores of every document, the combined score and the verdict."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    return Q.classify_keys(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the unigram model."""
    return K.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a rendering, and what is read back from it. The turns come as a log of messages, edits,
    deltas and regenerations, which is folded."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    done = C.render(C.fold_events(C.event_log(rows.unionByName(extra))))
    done = done.select("conv_id", "formatted", C.read_turns(F.col("formatted")).alias("turns"),
                       C.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    turns = F.array_join(F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                       F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = H.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return S.shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, weighted by their labels."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    docs = docs.select("doc_id", "source", M.n_words(F.col("text")).alias("size"))
    weights = M.quality_weights(table(spark, sf_dir, "labels", "doc_id", "quality"))
    mixed = M.mix(docs.join(weights, "doc_id", "left"), F.col("size"), F.col("weight"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the byte strings that smaller documents hold."""
    done = U.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    return P.conversation_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the reader finds it in the archives that were written of all pages."""
    records = W.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to",
                          "verified")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight, score and place in the draw of every document, with the benchmark as the target."""
    return I.importance_resample(table(spark, sf_dir, "documents", "doc_id", "text"),
                                 table(spark, sf_dir, "benchmark", "text"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = rf"""
WITH iw AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, 10 AS k, w[i:i + 9] AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM iw WHERE len(w) >= 10)
  UNION ALL
  SELECT DISTINCT item_id, len(w) AS k, w AS g FROM iw WHERE len(w) BETWEEN 1 AND 9),
dw AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
spots AS (
  SELECT r, i, k, w[i:i + k - 1] AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hits AS (SELECT r, i, spots.k, item_id FROM spots JOIN win ON spots.g = win.g AND spots.k = win.k),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, list(DISTINCT CAST(item_id AS VARCHAR)) FILTER (item_id IS NOT NULL) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
  sha256(coalesce(array_to_string(list_sort(ids), ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""

_ESCAPED = (r"regexp_replace(regexp_replace({}, '\\', '\\\\', 'g'), '(<|\[)(\|im_start\|>|\|im_end\|>|\|endoftext\|>"
            r"|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g')")

OP6_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace({_ESCAPED.format('role')}, chr(10), '\n') AS role_out, {_ESCAPED.format('text')} AS text_out FROM t),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum(length(role_out) + length(text_out) + 24) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars
FROM c
"""

OP9_SQL = r"""
WITH l AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    -ln((CAST('0x' || substr(md5('mix-7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE)
        / 4503599627370496::DOUBLE)
      / CASE WHEN q > 0 THEN 2.0::DOUBLE WHEN q IS NOT NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM documents LEFT JOIN l USING (doc_id)),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, 3 * source_size / w::DOUBLE AS c,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
       ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      ::DOUBLE / sum(w) OVER (
       ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      AS level
  FROM s),
g AS (SELECT arg_min(level, c) AS level FROM f WHERE level <= c),
t AS (
  SELECT source, source_size, least(3 * source_size::DOUBLE, g.level * w) AS target FROM f, g),
p AS (
  SELECT *, coalesce(CAST(floor(target / nullif(source_size, 0)) AS BIGINT), 0) AS epochs FROM t),
o AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN budget > 0 AND before + size / 2.0::DOUBLE <= budget THEN 1 ELSE 0 END) AS BIGINT)
    AS taken
FROM o
"""

OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT r, coalesce(doc_id, 9223372036854775807) AS doc_id, i, substr(h, 2 * i + 1, 100) AS g
  FROM (SELECT *, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
lost AS (SELECT r, i FROM w JOIN m USING (g) WHERE doc_id > least),
edges AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50, true) AS head FROM lost),
runs AS (SELECT r, i, sum(CAST(head AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS n FROM edges),
spans AS (SELECT r, n, min(i) AS s, max(i) + 50 AS e FROM runs GROUP BY r, n),
gaps AS (
  SELECT r, h, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a, s AS b FROM spans JOIN d USING (r)
  UNION ALL SELECT d.r, h, coalesce(last, 0), len(h) // 2
  FROM d LEFT JOIN (SELECT r, max(e) AS last FROM spans GROUP BY r) t ON d.r = t.r),
kept AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS k FROM gaps GROUP BY r),
sums AS (SELECT r, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN sums USING (r)
"""

#: CRC-32 of the hexadecimal digits h of a byte string, with the table of a CTE named crc.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len({h}) // 2),
    lambda i: CAST('0x' || substr({h}, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"""
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(256) t(i)))"""

OP11_SQL = rf"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST,
    sha256(length(role) || ':' || role || text)) AS t,
    hex(encode(coalesce(CAST(conv_id AS VARCHAR), ''))) AS hx
  FROM t GROUP BY conv_id),
h AS (SELECT conv_id, t, {_CRC.format(h='hx')} % 6 AS h FROM c, crc),
r AS (
  SELECT a.conv_id, CASE WHEN coalesce(a.conv_id % 100, 0) = 0 THEN a.t
    ELSE list_concat(coalesce(b.t[1:a.h], []), a.t[a.h + 1:]) END AS t
  FROM h a LEFT JOIN h b ON a.conv_id % 100 <> 0 AND b.conv_id = a.conv_id - a.conv_id % 100),
m AS (SELECT conv_id, t[1:d] AS p, d, d = len(t) AS ends FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM r)),
n AS (
  SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(coalesce(CAST(conv_id AS VARCHAR), ''), ',' ORDER BY conv_id NULLS LAST) FILTER (ends), '') AS ends,
    (count(*) - 1) * CASE WHEN any_value(d) > 0 THEN length(p[len(p)].text) ELSE 0 END AS saved
  FROM m GROUP BY p),
k AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
a AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (p)),
s AS (
  SELECT up AS p, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT saved, n_children, p[1:unnest(range(0, depth + 1))] AS up FROM a) GROUP BY up)
SELECT a.conv_id, a.depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM a JOIN s USING (p) LEFT JOIN a b ON a.depth > 0 AND b.p = a.p[1:a.depth - 1]
"""

OP12_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
q AS (
  SELECT *, row_number() OVER w AS k, first(page_id) OVER w AS head FROM p
  WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST))
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND k > 1 THEN head END AS refers_to, true AS verified
FROM q
"""

OP13_SQL = rf"""
WITH {_CRC_TABLE},
w AS (
  SELECT row_number() OVER () AS r, true AS own, doc_id, {WORDS} AS w FROM documents
  UNION ALL SELECT row_number() OVER () AS r, false, NULL, {WORDS} FROM benchmark),
f AS (
  SELECT r, own, unnest(w) AS f FROM w
  UNION ALL SELECT r, own, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
g AS (SELECT r, own, f, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT f, {_CRC.format(h='h')} % 10000 AS bucket FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM f), crc),
c AS (
  SELECT bucket, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t
  FROM g JOIN b USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM c) + 10000)
    / ((s + 1) * ((SELECT sum(t) FROM c) + 10000)))) AS BIGINT) AS gain FROM c),
d AS (
  SELECT r, sum(n) AS n_features, sum(n * gain) AS total FROM g JOIN b USING (f) JOIN gain USING (bucket)
  WHERE own GROUP BY r),
s AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
    CAST(coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN d USING (r) WHERE own),
p AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM s),
q AS (
  SELECT *, row_number() OVER (ORDER BY n_words >= 20 DESC, score DESC, doc_id NULLS LAST, n_features, weight) AS place
  FROM p)
SELECT doc_id, n_features, n_words, weight, score,
  CASE WHEN place <= (SELECT 25 * count(*) // 100 FROM p WHERE n_words >= 20) THEN place END AS rank
FROM q
"""

QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_html_extract, op3_rule_forest, op4_cotrain, op5_token_count, op6_chat_format, op7_simhash,
    op8_shard, op9_mix, op10_suffix_dedup, op11_prefix_trie, op12_warc, op13_resample)}
ORACLES = {"op1_decontaminate": OP1_SQL, "op6_chat_format": OP6_SQL, "op9_mix": OP9_SQL, "op10_suffix_dedup": OP10_SQL,
           "op11_prefix_trie": OP11_SQL, "op12_warc": OP12_SQL, "op13_resample": OP13_SQL}

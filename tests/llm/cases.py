"""Small inputs with nulls, empty and long texts, ties, repeated rows and extra columns."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
#: Names that clash with outputs of the operators.
CLASH = [T.StructField(n, T.StringType()) for n in
         ("n_words", "items", "hit_spans", "fingerprint", "kept", "score", "size", "shard", "slot", "group", "target",
          "taken", "n_tokens", "removed", "text_score", "n_chars_2", "range", "place")]


def texts(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["the", "of", "And", "thé", "ßen", "x", "run", "bread", "ñu", "zorro", "up", "9", "a-b", "idiot", "###"]
    out = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        out.append((i, " ".join(words) + rng.choice(["", "\n", " \t"]), "en", f"s{i % 4}", None))
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    out += [(100 + i, f"start {i} {passage} end {i}", "en", "s0", 3) for i in range(8)]
    out += [(200 + i, "same text for all of these rows, to be linked " * 3, "de", None, 5) for i in range(12)]
    out += [(300, None, None, None, None), (301, "", "en", "", 0), (302, " \n\t ", "en", "s1", 4), (None, passage, "en", "s1", 1),
            (None, None, None, None, None), (303, "word " * 5000, "en", "s2", 9), (303, "word " * 5000, "en", "s2", 9),
            (304, "de " * 300 + "\n" + "de " * 300, "en", "s2", 9), (305, "x", "en", "s3", 1),
            (306, "Ünïcödé 漢字 " * 30, "en", "s3", 1)]
    return out


def docs(spark, rows: list[tuple] | None = None, clash: bool = False):
    rows = texts() if rows is None else rows
    if not clash:
        return spark.createDataFrame(rows, DOCS).repartition(3)
    schema = T.StructType([*DOCS.fields, *CLASH])
    return spark.createDataFrame([(*r, *("c" for _ in CLASH)) for r in rows], schema).repartition(3)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")

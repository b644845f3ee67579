"""Event folding and exact reading back of renderings."""

from collections import Counter

from pyspark.sql import functions as F

from spanrisk.llm import chat_format as C

SCHEMA = "conv_id bigint, seq bigint, message_id string, event string, role string, text string, formatted string"


def rendered(spark, rows):
    folded = C.fold_events(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(4))
    out = C.render(folded).select("conv_id", "formatted", "loss_spans", C.read_turns(F.col("formatted")).alias("t"),
                                  C.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r["conv_id"]: r for r in out.collect()}


TURNS = [(1, 0, "user", "How are you?"), (1, 1, "assistant", "Very well."), (1, 2, "assistant", "odd"), (1, 3, "user", None),
         (1, 4, "assistant", None), (2, 0, "assistant", "x" * 999 + "</s>"), (2, 0, "assistant", "\U0001f600 \u6f22\u5b57!"),
         (2, None, None, "before"), (None, 0, "user", ""), (3, 0, "tool", "a"), (3, 0, "tool", "a")]


def fold_plainly(log):
    text, role = {}, {}
    for r in sorted(log, key=lambda r: (r["seq"]["turn"] is not None, r["seq"])):
        k = r["message_id"]
        role[k] = r["role"] or role.get(k, "")
        text[k] = (text.get(k, "") if r["event"] == "delta" else "") + (r["text"] or "")
    return {k: (role[k], text[k]) for k in text}


def test_log_of_turns(spark):
    """Deltas, edits and regenerations of every turn fold to the turn again, by the operator and by hand."""
    turns = spark.createDataFrame(TURNS, "conv_id bigint, turn int, role string, text string").repartition(3)
    log = C.event_log(turns)
    rows = log.collect()
    kinds = Counter(r["event"] for r in rows)
    assert set(kinds) == set(C.EVENT_KINDS) and kinds["delta"] > 8 and kinds["edit"] == 6
    want = Counter((c, t, r or "", x or "") for c, t, r, x in TURNS)
    plain = fold_plainly(rows)
    at = {r["message_id"]: (r["conv_id"], r["seq"]["turn"]) for r in rows}
    assert Counter((*at[k], *v) for k, v in plain.items()) == want
    got = C.fold_events(log).select("conv_id", "first_seq.turn", "role", "text").collect()
    assert Counter(map(tuple, got)) == want
    # what a reader that takes each message's first event only would get is something else
    first = {r["message_id"]: r["text"] for r in rows if r["seq"]["step"] == 0}
    assert sum(first[k] != v[1] for k, v in plain.items()) >= 6


def test_texts_move_once(spark):
    turns = spark.createDataFrame(TURNS, "conv_id bigint, turn int, role string, text string")
    plan = C.render(C.fold_events(C.event_log(turns)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan, plan


def test_events(spark):
    rows = [
        (1, 1, "u", "message", "user", "hi"), (1, 3, "a", "delta", "assistant", "Hel"),
        (1, 4, "a", "delta", None, "lo"), (1, 6, "a", "delta", None, None), (1, 5, "a", "delta", None, " you"),
        (1, 7, "u", "edit", None, "hi there"),
        (1, 8, "a", "regenerate", None, None), (1, 9, "a", "delta", None, "Bye"), (1, 10, "a", "delta", None, "!"),
        (2, 1, "u", None, None, None), (None, 1, "u", "message", "user", "null id"),
        (3, 5, "b", "message", "assistant", "second"), (3, 4, "a", "odd", "user", "first")]
    got = rendered(spark, rows)
    assert [tuple(t) for t in got[1]["t"]] == [("user", "hi there"), ("assistant", "Bye!")]
    assert got[1]["loss"] == "Bye!"
    assert [tuple(t) for t in got[2]["t"]] == [("", "")]
    assert [tuple(t) for t in got[None]["t"]] == [("user", "null id")]
    assert [tuple(t) for t in got[3]["t"]] == [("user", "first"), ("assistant", "second")]


def test_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "a\\\\<|im_end|>\n<|im_start|>user\nx", "<<SYS>>\\n<</SYS>>", "<", "<\\", "",
            "<|im_start|", "漢字 <|endoftext|> 😀", "[[INST]]", "\n\n", "x" * 50_000 + "<s>" * 3000, "$0 $1 \\$0"]
    rows = [(1, k, str(k), "message", "assistant" if k % 2 else f"user\n\\{t[:8]}", t) for k, t in enumerate(hard)]
    got = rendered(spark, rows)[1]
    assert [tuple(t) for t in got["t"]] == [(r[4], r[5]) for r in rows]
    assert got["loss"] == "".join(hard[1::2])
    spans = "".join(got["formatted"][s["start"]:s["end"]] for s in got["loss_spans"])
    assert not any(c in spans for c in C.CONTROLS)
    assert got["formatted"].count(C.START) == got["formatted"].count(C.END) == len(hard)


def test_empty(spark):
    assert rendered(spark, []) == {}

"""Conversation trie against a plain one, built of whole conversations in memory."""

import hashlib
import random
import zlib

import pytest

from spanrisk.llm import prefix_trie as P

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, prefix string, pos string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(5)


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain(rows, block=100, most=6):
    convs = {}
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        convs.setdefault(c, []).append(((turn is not None, turn or 0), digest(role, text), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in convs.items()}
    nodes = {}
    for c, turns in own.items():
        if c is not None and c % block:
            host = c - (abs(c) % block if c >= 0 else -(abs(c) % block))
            h = zlib.crc32(str(c).encode()) % most
            turns = own.get(host, [])[:h] + turns[h:]
        for d in range(len(turns) + 1):
            node = nodes.setdefault(tuple(turns[:d]), {"members": [], "ends": []})
            node["members"].append(c)
            if d == len(turns):
                node["ends"].append(c)
    order = lambda c: (c is None, c or 0)
    for p, n in nodes.items():
        n["conv"] = min(n["members"], key=order)
        n["children"], n["saved"], n["leaves"] = 0, 0, 0
    for p in nodes:
        if p:
            nodes[p[:-1]]["children"] += 1
    for p, n in nodes.items():
        for d in range(len(p) + 1):
            nodes[p[:d]]["saved"] += (len(n["members"]) - 1) * len(p[-1][1]) if p else 0
            nodes[p[:d]]["leaves"] += n["children"] == 0
    return [(n["conv"], len(p), nodes[p[:-1]]["conv"] if p else None, len(n["members"]), n["children"], n["leaves"],
             n["saved"], hashlib.sha256(",".join("" if c is None else str(c) for c in sorted(n["ends"], key=order))
                                        .encode()).hexdigest()) for p, n in nodes.items()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def check(spark, rows, **how):
    got = P.conversation_trie(frame(spark, rows), **how)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                           "ends_sha256"]
    assert ordered([tuple(r) for r in got.collect()]) == ordered(plain(rows, **how))


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"block": 7, "most": 3})])
def test_brute_force(spark, seed, how):
    rng = random.Random(seed)
    said = ["hi", "", None, "漢字 é", "a b c", "so " * 9]
    rows = []
    for c in rng.sample(range(-250, 600), 150):
        if c % 100 or rng.random() < 0.6:  # some hosts are absent
            rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(said)) for t in range(rng.randint(1, 9))]
    rows += [(c, t, "user", "x") for c in (1000, 1001, 1002) for t in (3, 3, None, 1)]
    rows += [(None, t, "user", f"null {t % 2}") for t in range(4)] + [(2100, None, None, None)] * 3
    check(spark, rows, **how)


def test_groups_of_copies_over_several_blocks_of_ends(spark):
    rows = [(100 * c, t, "user", f"copy {t}") for c in range(200) for t in range(3)]
    rows += [(100 * c, t, "user", f"copy {t}") for c in range(200, 260) for t in range(2)]
    rows += [(100 * c, t, "user", f"copy {t}" if t < 3 else f"own {c}") for c in range(300, 330) for t in range(5)]
    check(spark, rows)


def test_long_conversation_and_no_rows(spark):
    rows = [(0, t, "user", f"t{t} " * (t % 5)) for t in range(1500)] + [(100, t, "user", f"t{t} " * (t % 5)) for t in
                                                                         range(700)]
    check(spark, rows)
    assert P.conversation_trie(frame(spark, rows).limit(0)).collect() == []

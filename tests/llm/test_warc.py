"""Archives against a plain round trip; reading of damaged, plain and foreign archives."""

import glob
import gzip
import hashlib
import random
import zlib

import pytest

from spanrisk.llm import warc as W

SCHEMA = "page_id bigint, url string, html string, record_type string, head string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", None) for r in rows], SCHEMA).repartition(3)


def edge_rows():
    body = "<p>equal payload</p>" * 10
    rows = [(i, f"http://a/{i}", f"<html>{i} é漢 " + "x" * i + "</html>") for i in range(40)]
    rows += [(100 + i, f"http://b/{i % 3}", body) for i in range(30)] + [(120, "http://b/2", body)] * 4
    rows += [(None, None, body), (None, None, None), (None, "u", None), (7, None, ""), (8, "http://x/\r\nWARC-Type: y", "z")]
    rows += [(None, None, "null ids only " * 20)] * 5 + [(300, "v", "v" * 99)] * 2 + [(301, "v", "v" * 100)] * 2
    rows += [(400, "long", "long text " * 400_000), (401, "crlf", "\r\n\r\nWARC/1.1\r\n\r\n" * 500)]
    return rows


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2] or "", []).append(r)
    out = []
    for text, same in by.items():
        raw = text.encode()
        same = sorted(same, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
        for k, r in enumerate(same):
            again = k > 0 and len(raw) >= 100
            out.append((r[0], len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response",
                        same[0][0] if again else None, True, None))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("archive_bytes", [W.ARCHIVE_BYTES, 2000])
def test_round_trip(spark, archive_bytes):
    rows = edge_rows()
    got = W.round_trip(pages(spark, rows), archive_bytes=archive_bytes).select(
        "key", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified", "error")
    assert ordered([tuple(r) for r in got.collect()]) == ordered(plain(rows))


def test_files_are_archives_with_a_member_for_each_record(spark, tmp_path):
    rows = edge_rows()
    W.write_archives(pages(spark, rows), f"{tmp_path}/w", archive_bytes=50_000)
    n = 0
    for name in glob.glob(f"{tmp_path}/w/part-*"):
        raw = open(name, "rb").read()
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
        while raw:
            z = zlib.decompressobj(31)
            record = z.decompress(raw)
            assert z.eof and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            raw, n = z.unused_data, n + 1
    assert n == len(rows)
    got = W.read_archives(spark, f"{tmp_path}/w", payloads=True)
    ids = [r[0] for r in got.select("record_id").collect()]
    assert len(set(ids)) == len(ids) == n
    texts = {r[0].decode() for r in got.filter("record_type = 'response'").select("payload").collect()}
    assert texts == {r[2] or "" for r in rows}
    assert {r[0] for r in got.filter("record_type = 'revisit'").select("refers_to_record").collect()} <= set(ids)


def test_payload_of_over_16_mb(spark):
    rng = random.Random(1)
    rows = [(1, "u", "".join(rng.choices("abcdef<>", k=1000)) * 17_000), (2, "u", "short")]
    got = W.round_trip(pages(spark, rows).coalesce(1)).orderBy("key").collect()
    assert [(r["payload_bytes"], r["verified"]) for r in got] == [(17_000_000, True), (5, True)]


def test_empty(spark):
    assert W.round_trip(pages(spark, []).limit(0)).collect() == []


def records(n, **more):
    out = []
    for i in range(n):
        payload = bytes([65 + i]) * (50 * i) + b"WARC/1.1"
        out.append(W.format_record("response", f"<urn:r:{i}>", i, f"http://h/{i}", payload,
                                   hashlib.sha256(payload).hexdigest(), **more))
    return out


def test_plain_and_shared_members():
    want = [(i, 50 * i + 8, True, None) for i in range(6)]
    whole = b"".join(records(6))
    for data in (whole, W.member(whole), W.member(whole) + b"\0" * 9, b"".join(map(W.member, records(6))),
                 W.member(whole[:700]) + W.member(whole[700:])):
        got = list(W.read_records(data, payloads=True))
        assert [(r["key"], r["payload_bytes"], r["verified"], r["error"]) for r in got] == want
        assert [len(r["payload"]) for r in got] == [w[1] for w in want]
    starts = [0]
    for r in records(6):
        starts.append(starts[-1] + len(r))
    assert [r["offset"] for r in W.read_records(whole)] == starts[:-1]


def test_damage():
    parts = [W.member(r) for r in records(6)]
    broken = bytearray(parts[2])
    broken[40] ^= 0xFF
    got = list(W.read_records(b"".join([*parts[:2], bytes(broken), *parts[3:]])))
    assert [r["key"] for r in got if not r["error"]] == [0, 1, 3, 4, 5]
    assert len([r for r in got if r["error"]]) == 1 and got[2]["error"].startswith("gzip")
    cut = list(W.read_records(b"".join(parts)[:-20]))
    assert [r["key"] for r in cut if not r["error"]] == [0, 1, 2, 3, 4] and "cut short" in cut[-1]["error"]
    wrong = records(3)
    wrong[1] = wrong[1].replace(b"BBBB", b"BBBX")  # the digests no longer hold
    assert [r["verified"] for r in W.read_records(b"".join(map(W.member, wrong)))] == [True, False, True]
    short = records(3)
    short[1] = short[1].replace(b"Content-Length: ", b"Content-Length: 9")  # frames more than there is
    got = list(W.read_records(b"".join(map(W.member, short))))
    assert [r["key"] for r in got if not r["error"]][0] == 0 and any(r["error"] for r in got)
    assert list(W.read_records(b"")) == [] and list(W.read_records(b"no archive"))[0]["error"]


def test_foreign_records():
    warcinfo = (b"WARC/1.0\r\nwarc-type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nX-Long: a\r\n  b\r\n"
                b"Content-Length: 5\r\n\r\nhello\r\n\r\n")
    r = list(W.read_records(W.member(warcinfo)))[0]
    assert (r["record_type"], r["payload_bytes"], r["verified"], r["key"], r["error"]) == ("warcinfo", 5, None, None, None)
    odd = warcinfo.replace(b"X-Long: a", b"Content-Type: application/http")
    assert list(W.read_records(W.member(odd)))[0]["error"] == "block: no end of the HTTP header"

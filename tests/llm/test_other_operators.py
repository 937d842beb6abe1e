import base64
import gzip
import hashlib
import random
import time

import numpy as np
import pytest
from llm import brute
from pyspark.sql import functions as F

from brackenlog.llm import url_filter, warc
from brackenlog.llm.components import components
from brackenlog.llm.url_filter import UrlRule
from brackenlog.llm.vector_dedup import near_duplicate_vectors

PAGES = "page_id long, url string, html string"


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain(n, body, digest=None):
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{n}>\r\nWARC-Payload-Digest: sha1:{digest or sha(body)}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def check_cover(data, found):
    at = 0
    for x in found:
        assert x.start == at or x.start < at <= x.end
        at = x.end
    assert at == len(data)


@pytest.mark.parametrize("members", [False, True])
def test_salvage_recovers_what_follows_damage(members):
    bodies = [b"one", b"two WARC/1.0\r\n inside", b"", b"four" * 50, b"five"]
    parts = [gzip.compress(plain(n, b)) if members else plain(n, b) for n, b in enumerate(bodies)]
    clean = b"".join(parts)
    assert [x.block for x in warc.salvage(clean)] == bodies
    junk = parts[0] + b"\x00junk\xff" + parts[1] + parts[2][: len(parts[2]) // 2] + parts[3] + parts[4]
    found = list(warc.salvage(junk))
    assert [x.block for x in found if isinstance(x, warc.Record)] == [bodies[0], bodies[1], bodies[3], bodies[4]]
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    assert [x.end - x.start for x in gaps] == [6, len(parts[2]) // 2] and all(x.reason for x in gaps)
    check_cover(junk, found)


def test_salvage_takes_time_in_proportion():
    """Many members, and many gaps with no member or line after them, are read once."""
    rng = np.random.default_rng(5)
    member = gzip.compress(plain(1, rng.bytes(1 << 14)), 1)
    data = member * 4000
    began = time.monotonic()
    assert sum(isinstance(x, warc.Record) for x in warc.salvage(data)) == 4000
    broken = plain(2, b"x" * 3000, sha(b"y")) * 5000
    assert sum(isinstance(x, warc.Gap) for x in warc.salvage(broken)) == 5000
    assert time.monotonic() - began < 20 and len(data) > 60 << 20


def test_salvage_checks_digest_header_and_length():
    bad = plain(1, b"abc", digest=sha(b"abd"))
    for broken, reason in ((bad, "wrong digest"), (plain(1, b"abc").replace(b"Content-Length", b"Content-Size"), "no content length"), (plain(1, b"abc").replace(b": 3", b": 2"), "no end of record"), (b"WARC/1.0\r\nno field\r\n\r\n", "broken header"), (plain(1, b"abc")[:-1], "truncated block")):
        data = broken + plain(2, b"xyz")
        found = list(warc.salvage(data))
        assert isinstance(found[0], warc.Gap) and found[-1].fields["warc-record-id"] == "<urn:x-page:2>"
        assert reason in {x.reason for x in found if isinstance(x, warc.Gap)} or reason == "truncated block"
        check_cover(data, found)
    inner = gzip.compress(plain(1, b"abc") + b"rubbish" + plain(2, b"d"))
    found = list(warc.salvage(inner))
    assert [x.block for x in found if isinstance(x, warc.Record)] == [b"abc", b"d"] and "member" in [x for x in found if isinstance(x, warc.Gap)][0].reason
    assert list(warc.salvage(b"")) == [] and len(list(warc.salvage(b"nothing here"))) == 1


def test_random_damage_never_loses_a_byte():
    rng = random.Random(3)
    for _ in range(40):
        data = b"".join(rng.choice((plain, lambda n, b: gzip.compress(plain(n, b))))(n, rng.randbytes(rng.randrange(60))) for n in range(6))
        data = bytearray(data)
        for _ in range(rng.randrange(4)):
            a = rng.randrange(len(data))
            data[a : a + rng.randrange(5)] = rng.randbytes(rng.randrange(5))
        check_cover(bytes(data), list(warc.salvage(bytes(data))))


def test_pages_round_trip(spark, tmp_path):
    rows = [(5, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "u", None), (8, "u", ""), (None, "u", "<p>é</p>"), (3, "u", "WARC/1.0\r\nA: b\r\n\r\n"), (3, "u", "WARC/1.0\r\nA: b\r\n\r\n"), (7, "u", "x" * 300_000)]
    docs = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit(1)).withColumn("_same", F.lit(2))
    warc.write(warc.decide(docs), str(tmp_path / "w"))
    records = warc.read(spark, str(tmp_path / "w"))
    assert records.where("gap IS NOT NULL").count() == 0
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.pages(records).collect()), key=str)
    low = {}
    for i, _, h in rows:
        if i is not None:
            low[h or ""] = min(low.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        body, first = (h or "").encode(), low[h or ""]
        again = first != i
        want.append((i, len(body), sha(body), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    least = {r.page_id: r.record_type for r in warc.decide(docs.where("page_id IN (2, 5, 8, 9)"), least=5).collect()}
    assert least == {2: "response", 5: "revisit", 8: "response", 9: "response"}
    warc.write(warc.decide(spark.createDataFrame([], PAGES)), str(tmp_path / "e"))
    assert warc.pages(warc.read(spark, str(tmp_path / "e"))).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    for n, m in ((30, 20), (200, 150), (64, 63)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != 63 else [(k, k + 1) for k in range(63)]
        got = {r.node: r.component for r in components(spark.createDataFrame([(a, b) for a, b in links] + [links[0]], "a long, b long")).collect()}
        at = brute.components(n, links)
        assert got == {k: at[k] for a, b in links if a != b for k in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(25, 16))
    rows = []
    for k in range(400):
        v = base[rng.integers(25)] + rng.normal(size=16) * rng.choice((0.0, 0.05, 0.15, 0.25))
        rows.append((1000 - k, v.astype(np.float32).tolist(), int(rng.integers(3))))
    odd = [(1, None, 0), (2, [0.0] * 16, 0), (3, [None] + rows[0][1][1:], 0), (4, [float("nan")] * 16, 0), (5, rows[0][1], None), (6, [float("inf")] * 16, 1), (None, rows[0][1], 0), (7, [], 0), (8, [1.0, 2.0], 0)]
    twice = [(9, (np.array(rows[0][1]) * 2).tolist(), rows[0][2])]
    df = spark.createDataFrame(rows + odd + twice, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(0)).withColumn("weight", F.lit("x"))
    got = near_duplicate_vectors(df, tile=50).collect()
    real = rows + twice
    v = np.array([r[1] for r in real], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in real])
    linked = (v @ v.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    order = np.argsort([r[0] for r in real])
    place = {int(o): k for k, o in enumerate(order)}
    at = brute.components(len(real), [(place[a], place[b]) for a, b in np.argwhere(linked)])
    ids = sorted(r[0] for r in real)
    want = {r[0]: (int(linked[k].sum()), ids[at[place[k]]]) for k, r in enumerate(real)}
    assert len(got) == len(rows) + len(odd) + 1
    found = sum(r.n_links for r in got)
    assert found >= 0.9 * linked.sum() and found <= linked.sum()
    assert sum(want[r.vec_id] == (r.n_links, r.component_id) for r in got if r.vec_id in want) >= 0.9 * len(want)
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id not in want)
    assert near_duplicate_vectors(df.where("vec_id < 0")).count() == 0


def test_url_rules_and_parts(spark):
    rules = [UrlRule("allow", "org/"), UrlRule("block", "example.org/es/"), UrlRule("block", "com/de/")]
    urls = {1: "HTTP://A.Example.ORG/es/x?q#f", 2: "http://example.org", 3: "http://xexample.org/es/", 4: "https://m.com/de/1", 5: "http://com?x", 6: None, 7: "no host/de/", 8: "x://h://i/p", 9: "http://é.org\n/a\nb#c"}
    df = spark.createDataFrame(list(urls.items()), "page_id long, url string").withColumn("html", F.lit(None).cast("string")).withColumn("rule", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules).collect()}
    assert got == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"),
        2: ("example.org", "", None, "block"),  # the only host below it is blocked
        3: ("xexample.org", "/es/", "org/", "allow"),
        4: ("m.com", "/de/1", "com/de/", "block"),
        5: ("com", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("h:", "//i/p", None, "allow"),
        9: ("é.org\n", "/a\nb", None, "allow"),
    }
    assert url_filter.judge(df.limit(0), rules).count() == 0
    assert url_filter.judge(df, []).where("rule IS NOT NULL").count() == 0


def test_trust_follows_links_and_distrust_goes_back(spark):
    link = '<a href="{}">x</a>'
    pages = [
        (1, "http://good.aa/", link.format("http://friend.bb/")),
        (2, "http://friend.bb/", link.format("https://other.cc/x")),
        (3, "http://spam.dd/", link.format("http://bad.ee/") * 3 + link.format("/local")),
        (4, "http://bad.ee/", None),
        (5, "http://far.ff/", link.format("//spam.dd/")),
        (6, "http://alone.gg/", ""),
    ]
    rules = [UrlRule("allow", "good.aa/"), UrlRule("block", "bad.ee/")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(pages, PAGES), rules).collect()}
    assert {k: r.verdict for k, r in got.items()} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow"}
    # Against the same walk by matrices.
    hosts = ["good.aa", "friend.bb", "other.cc", "spam.dd", "bad.ee", "far.ff", "alone.gg"]
    step = np.zeros((7, 7))
    for a, b, w in ((0, 1, 1), (1, 2, 1), (3, 4, 3), (5, 3, 1)):
        step[a, b] = w
    for name, m, seed in (("trust", step, 0), ("distrust", step.T, 4)):
        share = m / np.maximum(1, m.sum(1, keepdims=True))
        start = np.eye(7)[seed]
        rank = start
        for _ in range(url_filter.ITERATIONS):
            rank = 0.15 * start + 0.85 * rank @ share
        for r in got.values():
            assert getattr(r, name) == pytest.approx(rank[hosts.index(r.host)], abs=1e-12)

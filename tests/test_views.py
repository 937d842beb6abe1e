import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from brackenlog.operators import blocks
from brackenlog.operators.lookups import prune_bookmarks, with_bookmarks, with_source_info
from brackenlog.operators.views import context_rows, match_ordinals, merge_sources, merge_times, union_sources

T0 = dt.datetime(2024, 1, 1)


def sources(rng, n):
    out = {}
    for s in range(n):
        rows, at = [], rng.randint(0, 40)
        for i in range(rng.randint(1, 30)):
            at += rng.randint(-2, 6)
            rows.append(None if rng.random() < 0.4 or s == 3 else at)
        out[f"s{s}"] = rows
    return out


def frame(spark, data):
    rows = [
        (s, int(s[1:]), i, None if t is None else T0 + dt.timedelta(seconds=t)) for s, ts in data.items() for i, t in enumerate(ts)
    ]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, "source string, source_ord int, entry_index long, ts timestamp_ntz")


def filled(ts):
    last = next((t for t in ts if t is not None), None)
    out = []
    for t in ts:
        last = t if t is not None else last
        out.append(last)
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 18])
def test_fill_position_and_context_equal_the_sequential_model(spark, block):
    rng = random.Random(block)
    data = sources(rng, 6)
    df = frame(spark, data)
    got = {}
    for r in blocks.forward_fill(df, "ts", "entry_index", block=block).collect():
        got.setdefault(r.source, {})[r.entry_index] = None if r.filled is None else (r.filled - T0).total_seconds()
    for s, ts in data.items():
        assert [got[s][i] for i in range(len(ts))] == filled(ts)

    some = df.filter(F.expr("(entry_index * 7 + source_ord) % 3 > 0"))  # gaps in the order column
    got = {}
    for r in blocks.dense_position(some, "entry_index", block=block).collect():
        got.setdefault(r.source, []).append((r.entry_index, r.position))
    for s, pairs in got.items():
        assert [p for _, p in sorted(pairs)] == list(range(len(pairs)))

    for n in (1, 2, 5):
        marked = some.withColumn("hit", F.expr("(entry_index + source_ord) % 11 = 0"))
        want = {}
        for s, ts in data.items():
            o = int(s[1:])
            seq = [i for i in range(len(ts)) if (i * 7 + o) % 3 > 0]
            hits = [p for p, i in enumerate(seq) if (i + o) % 11 == 0]
            want[s] = [i for p, i in enumerate(seq) if any(abs(p - h) <= n for h in hits)]
        got = {s: [] for s in data}
        for r in blocks.near_match(marked, "hit", n, "entry_index", block=block).collect():
            got[r.source].append(r.entry_index)
        assert {s: sorted(v) for s, v in got.items()} == want


def test_merge_equals_the_sequential_model(spark):
    data = sources(random.Random(1), 6)
    want = []
    for s, ts in data.items():
        for i, t in enumerate(filled(ts)):
            want.append((-10**6 if t is None else t, int(s[1:]), i))
    want.sort()
    got = sorted((r.position, r.source_ord, r.entry_index) for r in merge_sources(frame(spark, data)).collect())
    assert [(o, i) for _, o, i in got] == [(o, i) for _, o, i in want]
    assert [p for p, _, _ in got] == list(range(len(want)))
    lazy = [(r.source_ord, r.entry_index) for r in merge_sources(frame(spark, data), numbered=False).collect()]
    assert lazy == [(o, i) for _, o, i in want]


def test_a_timeless_source_sorts_first_and_banners_borrow(spark):
    df = union_sources([
        spark.createDataFrame([("a", 0, None), ("a", 1, T0 + dt.timedelta(seconds=3))], "source string, entry_index long, ts timestamp_ntz"),
        spark.createDataFrame([("b", 0, T0 + dt.timedelta(seconds=1))], "source string, entry_index long, ts timestamp_ntz"),
        spark.createDataFrame([("c", 0, None)], "source string, entry_index long, ts timestamp_ntz"),
    ])
    got = [(r.source, r.entry_index) for r in merge_sources(df).orderBy("position").collect()]
    assert got == [("c", 0), ("b", 0), ("a", 0), ("a", 1)]


def test_no_window_spans_a_whole_source(spark):
    df = frame(spark, {"s0": [1, 2]})
    for made in (merge_times(df), context_rows(df.withColumn("hit", F.lit(True)), "hit", 2)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "windowspecdefinition(source" in line and "_block" not in line:
                # Only over summaries: one row per block.
                assert "_first" in line or "_last" in line or "_n" in line or "count(1)" in line, line


def test_context_zero_keeps_the_view(spark):
    df = frame(spark, {"s0": [1, 2, 3]}).withColumn("hit", F.expr("entry_index = 1"))
    assert context_rows(df, "hit", 0).count() == 3


def test_ordinals_and_lookups(spark):
    df = frame(spark, {"s0": [1, 2, 3], "s1": [1]})
    got = match_ordinals(df.filter("entry_index <> 1")).orderBy("source", "entry_index").collect()
    assert [(r.source, r.ordinal, r.total) for r in got] == [("s0", 1, 2), ("s0", 2, 2), ("s1", 1, 1)]
    entries = df.withColumn("line_no", F.col("entry_index") + 1)
    marks = spark.createDataFrame([("s0", 2, "look"), ("gone", 1, "x")], "source string, line_no long, note string")
    assert [(r.source, r.entry_index, r.note) for r in with_bookmarks(entries, marks).collect()] == [("s0", 1, "look")]
    assert [r.note for r in prune_bookmarks(marks, entries).collect()] == ["look"]
    info = spark.createDataFrame([("s0", "web")], "source string, label string")
    assert {(r.source, r.label) for r in with_source_info(entries, info).collect()} == {("s0", "web"), ("s1", None)}

"""Mined patterns by what must hold of them, and a handful of cases of our own."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from brackenlog.operators.ladder import RUNGS, longest_common, pattern_ladder, rank_ladder
from brackenlog.operators.mining import message_template, templates

#: One way to vary each kind of value; the token around it stays the same word.
KINDS = {
    "integer": lambda rng: str(rng.randrange(10**6)),
    "decimal": lambda rng: f"{rng.randrange(1000)}.{rng.randrange(10, 99)}",
    "hex": lambda rng: f"0x{rng.randrange(1 << 32):x}",
    "ipv4": lambda rng: ".".join(str(rng.randrange(256)) for _ in range(4)),
    "uuid": lambda rng: "-".join(f"{rng.randrange(16**n):0{n}x}" for n in (8, 4, 4, 4, 12)),
    "quoted": lambda rng: f"'{rng.choice(['north', 'south', 'west'])}'",
}
WORDS = ["valve", "opened", "by", "pump", "after", "reset", "(main)", "ok.", "50%", "a|b", "[x]"]


def sentence(rng, kind):
    """A line of words with one value, as a function of the value."""
    words = rng.sample(WORDS, 4)
    at = rng.randrange(5)
    lead, tail = rng.choice([("", ""), ("n=", ""), ("(", ")"), ("", ",")])
    return lambda: " ".join([*words[:at], lead + KINDS[kind](rng) + tail, *words[at:]]), words


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_a_template_matches_other_values_and_no_other_words(spark, kind):
    rng = random.Random(kind)
    made = [sentence(rng, kind) for _ in range(25)]
    texts = [make() for make, _ in made]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.p for r in df.select("i", message_template(F.col("t")).alias("p")).collect()}
    for i, (make, words) in enumerate(made):
        pattern = re.compile(got[i])
        assert pattern.fullmatch(texts[i])
        assert all(pattern.fullmatch(make()) for _ in range(5)), (texts[i], got[i])
        for w in words:
            assert not pattern.fullmatch(texts[i].replace(w, "other", 1)), (texts[i], got[i])


def test_templates_of_our_own_lines(spark):
    cases = {
        "pump 12 primed": r"pump\s+\d+\s+primed",
        "quiet night": r"quiet\s+night",
        "   ": None,
        "8472": "8472",
        "level at 99.999.1.2": r"level\s+at\s+99\.999\.1\.2",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.p for r in df.select("t", message_template(F.col("t")).alias("p")).collect()} == cases


def test_random_tokens_match_their_own_template(spark):
    rng = random.Random(17)
    texts = ["w " + "".join(rng.choices("cd47.,=y0-#(", k=rng.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", message_template(F.col("t")).alias("p")).collect():
        assert re.fullmatch(r.p, r.t), r


def common_by_trial(a, b):
    """Length of the longest common subsequence, from all subsequences of the shorter list."""
    def within(part, whole):
        rest = iter(whole)
        return all(t in rest for t in part)

    a, b = sorted((a, b), key=len)
    return next(n for n in range(len(a), -1, -1) if any(within(c, b) for c in combinations(a, n)))


def test_longest_common_is_common_and_longest():
    rng = random.Random(2)
    for _ in range(400):
        a, b = (rng.choices("rstu", k=rng.randrange(8)) for _ in range(2))
        got = longest_common(a, b)
        for whole in (a, b):
            rest = iter(whole)
            assert all(t in rest for t in got)
        assert len(got) == common_by_trial(a, b)
    # Of two equally long ones, that which skips tokens of the first list.
    assert longest_common(["r", "s"], ["s", "r"]) == ["s"]
    assert longest_common([], ["r"]) == [] == longest_common(["r"], [])


def groups(rng):
    """Selections: values that vary, a changing word, different lengths, copies, blanks."""
    out = []
    for k in range(60):
        make, words = sentence(rng, rng.choice(sorted(KINDS)))
        members = [make() for _ in range(rng.randint(1, 4))]
        if k % 4 == 1:
            members = [m.replace(words[0], rng.choice(["red", "blue"]), 1) for m in members]
        if k % 4 == 2:
            members = [m + " again" * rng.randrange(3) for m in members]
        if k % 10 == 3:
            members.append(members[0])
        if k % 10 == 7:
            members.append("  ")
        out.append(members)
    return [*out, ["  ", " "], ["left", "right turn"]]


def test_ladders(spark):
    rng = random.Random(11)
    made = groups(rng)
    rows = [(k, i, m) for k, g in enumerate(made) for i, m in enumerate(g)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key int, order int, message string")
    ladder = pattern_ladder(df).collect()
    by_key = {}
    for r in ladder:
        by_key.setdefault(r.key, {})[r.rung] = r
    for k, members in enumerate(made):
        rungs, filled = by_key.get(k, {}), [m.strip() for m in members if m.strip()]
        if not filled:
            assert not rungs
            continue
        assert set(rungs) <= set(RUNGS)
        assert len({r.pattern for r in rungs.values()}) == len(rungs)
        for name, r in rungs.items():
            # What a rung says holds of all messages; blank ones are left to the exact rung's default.
            search = re.fullmatch if name in ("wildcard", "typed", "exact") else re.search
            assert all(search(r.pattern, m) for m in filled), (members, name, r.pattern)
        if "prefix" in rungs:
            assert len({m.split()[0] for m in filled}) == 1
        defaults = [r for r in rungs.values() if r.is_default]
        assert len(defaults) == (len(members) > 1)
        if defaults and "typed" in rungs:
            assert defaults[0].rung == "typed" or defaults[0].pattern == rungs["typed"].pattern


def test_rungs_of_our_own_selections(spark):
    made = {
        0: ["door 4 shut", "door 9 shut"],
        1: ["tank low", "valve open now"],
        2: ["rain in bay 3", "rain over bay 44 again"],
        3: ["x(7)", "x(81)"],
    }
    df = spark.createDataFrame([(k, i, m) for k, g in made.items() for i, m in enumerate(g)], "key int, order int, message string")
    got = {(r.key, r.rung): (r.pattern, r.is_default) for r in pattern_ladder(df).collect()}
    assert got == {
        (0, "loose"): ("door.*shut", False),
        (0, "prefix"): ("door.*", False),
        (0, "wildcard"): (r"door\s+\S+\s+shut", False),
        (0, "typed"): (r"door\s+\d+\s+shut", True),
        (0, "exact"): ("(?:door 4 shut|door 9 shut)", False),
        (1, "exact"): ("(?:tank low|valve open now)", True),
        (2, "loose"): ("rain.*bay", True),
        (2, "prefix"): ("rain.*", False),
        (2, "exact"): ("(?:rain in bay 3|rain over bay 44 again)", False),
        (3, "typed"): (r"x\(\d+\)", True),
        (3, "exact"): (r"(?:x\(7\)|x\(81\))", False),
    }


def test_every_rung_is_counted_against_its_messages(spark):
    made = {0: ["door 4 shut", "door 9 shut"], 1: ["tank low", "valve open now"]}
    df = spark.createDataFrame([(k, i, m) for k, g in made.items() for i, m in enumerate(g)], "key int, order int, message string")
    assert {r.hits for r in rank_ladder(pattern_ladder(df), df).collect()} == {2}


def test_templates_of_a_log(spark):
    df = spark.createDataFrame([(i, f"drained {i} litres" if i % 2 else "idle") for i in range(10)], "i int, m string")
    df = df.withColumn("ts", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, i)"))
    got = {r.template: (r.entries, r.example, r.first_ts.second, r.last_ts.second) for r in templates(df, F.col("m"), "i").collect()}
    assert got == {r"drained\s+\d+\s+litres": (5, "drained 1 litres", 1, 9), "idle": (5, "idle", 0, 8)}


def test_messages_that_hold_all_common_tokens_need_no_table(spark, monkeypatch):
    from brackenlog.operators import ladder

    rng = random.Random(5)
    texts = [" ".join(["job", str(k), *rng.sample(["slow", "cold"], rng.randrange(3)), "done"]) for k in range(300)]
    want = texts[0].split()
    for text in texts[1:]:
        want = longest_common(want, text.split())
    calls = []
    monkeypatch.setattr(ladder, "longest_common", lambda x, y: calls.append(1) or longest_common(x, y))
    frames = [__import__("pandas").DataFrame({"key": ["a"] * 300 + ["b"], "plain": [*texts, ""]})]
    got = {k: c for f in ladder._fold_common(iter(frames)) for k, c in zip(f["key"], f["common"])}
    assert got == {"a": want, "b": []} and len(calls) <= len(texts[0].split())

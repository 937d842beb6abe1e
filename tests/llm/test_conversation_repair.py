"""Conversation repair against exhaustive edits, a full CYK table and a plain model of the query."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from brackenlog.llm import conversation_repair as cr

TURNS = "conv_id long, turn long, role string, text string"
CODES = "suaoSUAOx"


def cheapest_by_trial(codes, most_inserts=2):
    """All edits, one by one."""
    best = None

    def go(i, roles, cost, audit, inserts):
        nonlocal best
        if not re.fullmatch(r"(s?(ua)*u?)?", roles):
            return
        if i == len(codes) and re.fullmatch(r"(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        if inserts < most_inserts:
            for role in "ua":
                go(i, roles + role, cost + 3, audit + "I", inserts + 1)
        if i < len(codes):
            x = codes[i]
            go(i + 1, roles, cost + 4, audit + "D", 0)
            if x != "x":
                more = 3 if x.isupper() else 0
                go(i + 1, roles + x.lower(), cost + more, audit + "K", 0)
                for role in "ua":
                    go(i + 1, roles + role, cost + 3 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_parse_is_the_cheapest_of_all_edits(seed):
    rng = random.Random(seed)
    for _ in range(60):
        codes = "".join(rng.choice(CODES) for _ in range(rng.randint(0, 5)))
        assert cr.cheapest(cr.parse(codes)) == cheapest_by_trial(codes), codes


@pytest.mark.parametrize("seed", range(4))
def test_every_split_point_of_a_span_gives_its_cell(seed):
    rng = random.Random(seed)
    codes = "".join(rng.choice(CODES) for _ in range(17))
    cells = {(i, i + 1): cr.TURNS[c] for i, c in enumerate(codes)}
    for length in range(2, len(codes) + 1):
        for i in range(len(codes) - length + 1):
            found = {cr._combine(cells[i, k], cells[k, i + length]) for k in range(i + 1, i + length)}
            assert len(found) == 1
            cells[i, i + length] = found.pop()
    assert cells[0, len(codes)] == cr.parse(codes)


def model(rows):
    """rows of one conversation (turn, role, text), damaged already, in order."""
    empty = hashlib.sha256(b"").hexdigest()
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", empty
    codes, seen, count = "", set(), [0, 0, 0]
    for _, role, text in rows:
        code = role[:1] if role[:1] in tuple("sua") else "o"
        if not re.search(r"[^\x20\x09-\x0D]", text):
            count[0] += 1
            code = "x"
        elif (role, text) in seen:
            count[1] += 1
            code = "x"
        elif not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text):
            count[2] += 1
            code = code.upper()
        seen.add((role, text))
        codes += code
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    # Forward, turn by turn: the least (cost, audit, roles) for each legal beginning.
    state = {"": (0, "", ())}

    def leads(roles):
        return {"s": "s", "u": "u", "a": "a"}[roles[-1]] if roles else ""

    def close(state):
        while True:
            more = dict(state)
            for at, (cost, audit, out) in state.items():
                for role in ("user", "assistant"):
                    if (at, role[0]) in {("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                        found = (cost + 3, audit + "I", out + (f"{role}:",))
                        if role[0] not in more or found[:2] < more[role[0]][:2]:
                            more[role[0]] = found
            if more == state:
                return state
            state = more

    for code, (_, role, text) in zip(codes, rows):
        after = {}

        def offer(at, found):
            if at not in after or found[:2] < after[at][:2]:
                after[at] = found

        for at, (cost, audit, out) in close(state).items():
            offer(at, (cost + 4, audit + "D", out))
            if code == "x":
                continue
            more = 3 if code.isupper() else 0
            steps = {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}
            if (at, role[:1]) in steps:
                offer(role[:1], (cost + more, audit + "K", out + (f"{role}:{text}",)))
            for new in ("user", "assistant"):
                if (at, new[0]) in steps:
                    offer(new[0], (cost + 3 + more, audit + "R", out + (f"{new}:{text}",)))
        state = after
    state = close(state)
    cost, audit, out = min(state[k] for k in ("", "a") if k in state)
    return gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def order(row):
    turn, role, text = row
    return turn is not None, turn or 0, role.encode(), hashlib.md5(text.encode()).hexdigest()


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fate = zlib.crc32(key.encode()) % 20
        own = out.setdefault(conv, [])
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def check(df, kept):
    found = {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}
    assert found.keys() == kept.keys()
    for conv, rows in kept.items():
        assert found[conv] == model(sorted(rows, key=order)), conv


@pytest.mark.parametrize("seed", range(3))
def test_query_equals_the_model(spark, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why? ", "and then", "", " \t", "...", "é.", None, "a.\n b"]
    rows = []
    for conv in [*range(80), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), role, rng.choice(texts)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).withColumns({"gaps": F.lit("x"), "present_": F.lit(False), "audit": F.lit(1)})
    check(cr.repair(cr.damaged(df)), damage(rows))


def test_long_conversation_is_parsed_in_runs(spark):
    rng = random.Random(7)
    rows = [(1, t, ("user", "assistant")[t % 2] if rng.random() < 0.9 else "system", f"{t % 900} text" + rng.choice([".", "", "!"])) for t in range(3000)]
    rows += [(2, 5, "user", "same.")] * 500 + [(3, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, TURNS).repartition(7)
    kept = {}
    for conv, *row in rows:
        kept.setdefault(conv, []).append(tuple(row))
    check(cr.repair(df), kept)
    found = cr.audits(df)
    turns = cr.repaired(df, found).orderBy("conv_id", "at").where("at IS NOT NULL").collect()
    for conv in kept:
        own = [r for r in turns if r.conv_id == conv]
        assert [r["at"] for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own))


def test_empty_table_and_conversation_without_turns(spark):
    empty = spark.createDataFrame([], TURNS)
    assert cr.repair(empty).count() == 0 and cr.repaired(empty, cr.audits(empty)).count() == 0
    gone = spark.createDataFrame([("c", 1, "user", "Hi.", False)], "conv_id string, turn int, role string, text string, present boolean")
    row = cr.repair(gone).collect()[0]
    assert row.conv_id == "c" and (row.cost, row.audit, row.illegal, row.repaired_sha256) == (0, "", 0, hashlib.sha256(b"").hexdigest())

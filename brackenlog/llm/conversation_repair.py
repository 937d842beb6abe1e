"""Repair of conversation structure by weighted interval parsing.

A legal conversation is empty, or an optional system turn and then pairs of a user turn and an
assistant turn: ``(s?(ua)+)?`` in the initials of the roles. Edits keep, re-role, delete or insert
turns at a cost; the cheapest edits that make the conversation legal are found by a CYK parse.

* **Grammar, in Chomsky normal form.** A nonterminal ``<p q>`` derives every piece that takes a
  conversation from situation ``p`` to situation ``q``; the situations are *start*, *after system*,
  *after user* and *after assistant*. Productions are ``<p q> -> <p r> <r q>`` and, for single
  turns, ``<p q> -> edit``. The whole is ``<start start>`` or ``<start after assistant>``.
* **Cells.** The cell of a span and a nonterminal holds its least ``(cost, audit)``. The audit, the
  initials of the edits, fixes the cost, and two audits of one span never extend one another at
  equal cost, so the least of two parts is always part of a least whole.
* **Insertion closure.** Inserted turns cover no input. Their cheapest chains between any two
  situations are closed once, and stand on both sides of every single-turn cell.
* **Bottom-up by span length.** Spans of 1, 2, 4, ... turns are combined. A nonterminal can be cut
  at any turn, so all split points of a span give the same cell and one is enough: the work is
  linear in the turns instead of cubic. Short spans recur and are kept in a memo.
* **Long conversations are split over tasks.** Turns are ranged by conversation and order, each
  task parses its run of a conversation to one row of cells, and those rows are combined by the
  same production. Equal turns are counted before the shuffle. Texts take no part in this; their
  digests do.
* Only the repaired text of a conversation is a sequence by nature: its turns are streamed in
  order through one task, which holds a batch and the audit (a byte a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from brackenlog.llm.components import stored

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
SITUATIONS = range(4)
#: How a turn of each role leads on.
STEPS = {"s": [(START, SYSTEM)], "u": [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
#: Spans of up to this many turns are kept in the memo, and the memo is emptied at this size.
MEMO_SPAN, MEMO_CELLS = 8, 100_000

Cell = tuple  # sixteen entries of (cost, audit) or None, one for each nonterminal


def _combine(a: Cell, b: Cell) -> Cell:
    """Cells of a span from those of its two parts."""
    out: list = [None] * 16
    for p in SITUATIONS:
        for r in SITUATIONS:
            left = a[4 * p + r]
            if left is None:
                continue
            for q in SITUATIONS:
                right = b[4 * r + q]
                if right is None:
                    continue
                best, cost = out[4 * p + q], left[0] + right[0]
                if best is None or cost <= best[0]:
                    found = (cost, left[1] + right[1])
                    if best is None or found < best:
                        out[4 * p + q] = found
    return tuple(out)


def _least(options: list[tuple[int, int, int, str]]) -> Cell:
    out: list = [None] * 16
    for p, q, cost, audit in options:
        if out[4 * p + q] is None or (cost, audit) < out[4 * p + q]:
            out[4 * p + q] = (cost, audit)
    return tuple(out)


def _closure() -> Cell:
    """Cheapest chains of inserted turns between any two situations, the empty one included."""
    cell = _least([(p, p, 0, "") for p in SITUATIONS] + [(p, q, INSERT, "I") for role in "ua" for p, q in STEPS[role]])
    while (after := _combine(cell, cell)) != cell:
        cell = after
    return cell


CLOSURE = _closure()


def _turn(code: str) -> Cell:
    """Cells of one turn. A code is the role's initial, ``o`` for other roles, in upper case where
    the text is truncated, or ``x`` for a turn that must go."""
    options = [(p, p, DELETE, "D") for p in SITUATIONS]
    if code != "x":
        more = TRUNCATED if code.isupper() else 0
        options += [(p, q, more, "K") for p, q in STEPS.get(code.lower(), [])]
        options += [(p, q, REROLE + more, "R") for role in "ua" for p, q in STEPS[role]]
    return _combine(_combine(CLOSURE, _least(options)), CLOSURE)


TURNS = {code: _turn(code) for code in "suaoSUAOx"}
_MEMO: dict[str, Cell] = {}


def parse(codes: str) -> Cell:
    """Cells of a whole span, from those of 1, 2, 4, ... turns."""
    if not codes:
        return CLOSURE
    level, length = [TURNS[code] for code in codes], 1
    while len(level) > 1:
        above = []
        for k in range(0, len(level) - 1, 2):
            span = codes[k * length : (k + 2) * length] if 2 * length <= MEMO_SPAN else None
            cell = _MEMO.get(span) if span else None
            if cell is None:
                cell = _combine(level[k], level[k + 1])
                if span:
                    if len(_MEMO) >= MEMO_CELLS:
                        _MEMO.clear()
                    _MEMO[span] = cell
            above.append(cell)
        if len(level) % 2:
            above.append(level[-1])
        level, length = above, 2 * length
    return level[0]


def cheapest(cell: Cell) -> tuple[int, str]:
    """Cost and audit of the whole conversation."""
    return min(x for x in (cell[4 * START + START], cell[4 * START + ASSISTANT]) if x is not None)


def _packed(cell: Cell) -> list[str | None]:
    return [None if x is None else f"{x[0]} {x[1]}" for x in cell]


def _unpacked(packed: list[str | None]) -> Cell:
    return tuple(None if x is None else (int(x.split(" ")[0]), x.split(" ")[1]) for x in packed)


def blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def truncated(text: Column) -> Column:
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def _given(turns: DataFrame) -> DataFrame:
    present = F.coalesce(F.col("present"), F.lit(True)) if "present" in turns.columns else F.lit(True)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), present.alias("present")).withColumn("digest", F.md5("text"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


#: What a task gives for its run of a conversation.
SEGMENT = "n long, first_turn long, last_turn long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, cells array<string>"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
COUNTS = ("blank", "duplicate", "truncated", "illegal")


ARROW = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def _names(columns: str) -> list[str]:
    return ["conv_id", *(x.split()[0] for x in columns.split(","))]


def _schema(batch, columns: str) -> pa.Schema:
    """The Arrow schema of ``conv_id``, as it is in a batch, and of ``columns``."""
    return pa.schema([batch.schema.field("conv_id"), *(pa.field(x.split()[0], ARROW[x.split()[1]]) for x in columns.split(","))])


def _segments(batches) -> Iterator[pa.RecordBatch]:
    """Runs of turns of one conversation, each to one row."""
    names = _names(SEGMENT)
    done: list[dict] = []
    run, codes = None, []

    def close():
        if run is not None:
            run["cells"] = _packed(parse("".join(codes)))
            run.pop("key")
            done.append(run)
            codes.clear()

    schema = None
    for batch in batches:
        schema = schema or _schema(batch, SEGMENT)
        for conv, turn, present, initial, empty, cut, seen, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "present", "initial", "empty", "cut", "seen", "copies"))):
            key = (conv,)
            if run is None or run["key"] != key:
                close()
                run = dict.fromkeys(names) | dict.fromkeys(("n", "turns", *COUNTS), 0) | {"key": key, "conv_id": conv}
            if not present:
                continue
            if turn is not None:
                run["turns"] += turn != run["last_turn"]
                run["low"] = turn if run["low"] is None else run["low"]
                run["high"] = turn
            if run["n"] == 0:
                run["first_turn"], run["first_initial"] = turn, initial
            else:
                run["illegal"] += (run["last_initial"], initial) not in LEGAL
            run["illegal"] += (copies - 1) * ((initial, initial) not in LEGAL)
            run["last_turn"], run["last_initial"] = turn, initial
            run["n"] += copies
            if empty:
                run["blank"] += copies
                codes.append("x" * copies)
                continue
            run["duplicate"] += copies - (not seen)
            code = "x"
            if not seen:
                code = initial if initial in STEPS else "o"
                code = code.upper() if cut else code
                run["truncated"] += cut
            codes.append(code + "x" * (copies - 1))
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, schema)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _joined(batches) -> Iterator[pa.RecordBatch]:
    """The runs of a conversation, in order, to its audit."""
    names = _names(AUDIT)
    schema, done, held = None, [], []

    def close():
        if not held:
            return
        filled = [x for x in held if x["n"]]
        out = dict.fromkeys(names, 0) | {"conv_id": held[0]["conv_id"], "audit": ""}
        if filled:
            for c in COUNTS:
                out[c] = sum(x[c] for x in filled)
            turns = sum(x["turns"] for x in filled)
            for a, b in zip(filled, filled[1:]):
                out["illegal"] += (a["last_initial"], b["first_initial"]) not in LEGAL
                turns -= b["first_turn"] is not None and a["last_turn"] == b["first_turn"]
            low = [x["low"] for x in filled if x["low"] is not None]
            if low:
                out["gaps"] = max(x["high"] for x in filled if x["high"] is not None) - min(low) + 1 - turns
            level = [_unpacked(x["cells"]) for x in filled]
            while len(level) > 1:
                level = [_combine(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
            out["cost"], out["audit"] = cheapest(level[0])
        done.append(out)
        held.clear()

    for batch in batches:
        schema = schema or _schema(batch, AUDIT)
        for row in batch.to_pylist():
            if held and held[0]["conv_id"] != row["conv_id"]:
                close()
            held.append(row)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, schema)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def audits(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` for every conversation.

    ``turns`` has ``conv_id, turn, role, text``; where it also has a boolean ``present``, a row for
    which that is false only names its conversation. Turns are taken by ``turn``, nulls first, then
    by role and a digest of the text; equal rows stay together.

    Defined cases: null roles and texts are one space, so a null text is blank and a null role no
    legal one. A null ``conv_id`` is a conversation of its own. A conversation without turns has
    zeros and an empty audit. Other columns are ignored. An empty table gives no rows.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    same = _given(turns).groupBy("conv_id", "turn", "role", "digest", "present").agg(
        F.first(F.substring("role", 1, 1)).alias("initial"), F.first(blank(F.col("text"))).alias("empty"), F.first(truncated(F.col("text"))).alias("cut"), F.count(F.lit(1)).alias("copies")
    )
    first = Window.partitionBy("conv_id", "role", "digest", "present").orderBy(F.col("turn").asc_nulls_first())
    facts = stored(same.withColumn("seen", F.row_number().over(first) > 1), "turn-facts")
    ranged = facts.repartitionByRange("conv_id", *_order()).sortWithinPartitions("conv_id", *_order())
    segments = ranged.select("conv_id", "turn", "present", "initial", "empty", "cut", "seen", "copies").mapInArrow(_segments, f"conv_id {kind}, {SEGMENT}")
    # Runs are in order by where they begin; a run without turns names its conversation only.
    placed = segments.withColumn("run", F.monotonically_increasing_id())
    return placed.repartition("conv_id").sortWithinPartitions("conv_id", "run").drop("run").mapInArrow(_joined, f"conv_id {kind}, {AUDIT}")


def _edited(batches) -> Iterator[tuple[dict, str, str, str]]:
    """The edits of each conversation in order: its audit row, the edit, role and text after it."""
    head, audit, at, situation = None, "", 0, START

    def expected():
        return "assistant" if situation == USER else "user"

    def inserted():
        nonlocal at, situation
        while at < len(audit) and audit[at] == "I":
            role = expected()
            situation = ASSISTANT if role == "assistant" else USER
            at += 1
            yield head, "I", role, ""

    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                if head is not None:
                    yield from inserted()
                head, audit, at, situation = row, row["audit"], 0, START
                yield head, "", "", ""
                continue
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit == "D":
                yield head, "D", row["role"], row["text"]
                continue
            role = row["role"] if edit == "K" else expected()
            situation = SYSTEM if role[:1] == "s" else ASSISTANT if role[:1] == "a" else USER
            yield head, edit, role, row["text"]
    if head is not None:
        yield from inserted()


def _with_audits(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit row and then its turns in order, conversation after conversation."""
    rows = _given(turns).where("present").drop("present")
    both = rows.unionByName(found, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_order()).drop("digest")


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns, ``conv_id, at, role, text, edit``, with the deleted ones (``at`` null).

    ``found`` is what ``audits(turns)`` gave. Rules for odd rows are those of ``audits``.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    columns = "at long, role string, text string, edit string"

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        at, rows, schema = 0, [], _schema(first, columns)
        for head, edit, role, text in _edited(chain([first], batches)):
            if edit == "":
                at = 0
                continue
            rows.append({"conv_id": head["conv_id"], "at": None if edit == "D" else at, "role": role, "text": text, "edit": edit})
            at += edit != "D"
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return _with_audits(turns, found).mapInArrow(run, f"conv_id {kind}, {columns}")


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with ``repaired_sha256``, of the repaired ``role:text`` joined by line breaks."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = _names(f"{AUDIT}, repaired_sha256 string")

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        schema = _schema(first, f"{AUDIT}, repaired_sha256 string")
        rows, head, sha, some = [], None, None, False

        def close():
            if head is not None:
                rows.append({c: head[c] for c in names[:-1]} | {"repaired_sha256": sha.hexdigest()})

        for of, edit, role, text in _edited(chain([first], batches)):
            if edit == "":
                close()
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows.clear()
                head, sha, some = of, hashlib.sha256(), False
            elif edit != "D":
                sha.update(("\n" if some else "").encode() + f"{role}:{text}".encode())
                some = True
        close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return _with_audits(turns, found).mapInArrow(run, f"conv_id {kind}, {AUDIT}, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """``audits`` with the digest of each repaired conversation."""
    return digests(turns, stored(audits(turns), "conversation-audits"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with planted faults, by the checksum of ``conv_id:turn`` modulo 20.

    0 drops the row (it stays with ``present`` false), 1 empties its text, 2 removes its sentence
    ends, 3 repeats it, 4 sets its role to user. Nulls are one space.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fate"))
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (fate != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1))))
    return out.drop("col")

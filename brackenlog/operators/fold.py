"""Physical lines to entries: a line that starts no entry belongs to the one above it.

Lines carry ``source``, ``split`` (a bounded run of the source, numbered in order), ``pos``
(order within the split) and ``value``. The state between two lines is only whether an
entry is open, so a split can be summarised in one row: what it does to that state and how
many entries it begins, in either case. A small scan over those rows tells every split
how it is entered, and lines at its head that continue an earlier entry are sent to the
split that entry began in.

The first pass reads the flags of the lines only. Where lines come as a scan gives them, a task
summarises its splits where they are and nothing is shuffled; lines from anywhere else shuffle
their flags. Its result, one row per split, is written to the shared folder and counted. Up to
``CARRY_ROWS`` of them are broadcast, so the second pass shuffles the text once; beyond that they
are joined, and the text moves a second time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from brackenlog.functions.text import is_blank, trim_line_end
from brackenlog.operators.extract import Schemas, _pick, as_list
from brackenlog.plans.schema import LogSchema
from brackenlog.session import stored

SPLIT_LINES = 1 << 20
#: Rows of about 100 bytes that may be broadcast, one for each split of a source with several. At
#: 128 MB a split they stand for 64 TB of such sources.
CARRY_ROWS = 500_000


def by_line_number(lines: DataFrame, split_lines: int = SPLIT_LINES) -> DataFrame:
    """Give lines that are already numbered from 1 their ``split`` and ``pos``."""
    return lines.withColumns(
        {
            "split": F.floor((F.col("line_no") - 1) / F.lit(split_lines)).cast("long"),
            "pos": F.col("line_no"),
        }
    )


def split_text(df: DataFrame, text: str, source: Column) -> DataFrame:
    """Rows of text with line breaks to numbered lines; each row is one source."""
    return df.select(
        source.alias("source"), F.posexplode(F.split(F.col(text), "\n")).alias("_at", "_line")
    ).select("source", (F.col("_at") + 1).cast("long").alias("line_no"), trim_line_end(F.col("_line")).alias("value"))


def _flags(sets: list[list[LogSchema]], set_col: Column) -> dict[str, Column]:
    line = F.col("value")

    def any_of(tests: list[Column]) -> Column:
        out = F.lit(False)
        for i, test in enumerate(tests):
            out = out | test if i else test
        return out

    starts = [any_of([s.starts(line) for s in group]) if group else F.lit(True) for group in sets]
    ends = [any_of([s.ends(line) for s in group if s.end_pattern]) for group in sets]
    explicit = [F.lit(any(s.explicit_boundary for s in group)) for group in sets]
    return {
        "_st": _pick(set_col, starts),
        "_en": _pick(set_col, ends),
        "_skip": _pick(set_col, explicit) & is_blank(line),
    }


def _after() -> Column:
    """What a line leaves behind: an open entry, none, or (null) whatever was before it."""
    return F.when(~F.col("_skip"), ~F.col("_en")).when(F.col("_en"), F.lit(False))


def _begins(is_open: Column) -> Column:
    """A dropped line (blank, between entries, explicit boundaries) begins nothing."""
    return (~is_open & ~F.col("_skip")) | (is_open & F.col("_st"))


def fold_entries(
    lines: DataFrame,
    schemas: Schemas = (),
    sets: Sequence[Sequence[int]] | None = None,
    scanned: bool = False,
    carry_rows: int = CARRY_ROWS,
) -> DataFrame:
    """Entries ``source, entry_index, line_no, raw`` of every source.

    Without schemas every line is an entry. With ``sets``, an int column ``schema_set``
    picks the schemas of a line's source; it is kept in the result. ``scanned`` says that the
    lines of a split are together and in order, as ``read_lines`` gives them; it fails where
    that is not so.
    """
    flagged = flagged_lines(lines, schemas, sets)
    summary = stored(_summary(flagged, scanned), "splits")
    return fold_flagged(flagged, summary, scanned, carry_rows)


def flagged_lines(
    lines: DataFrame, schemas: Schemas = (), sets: Sequence[Sequence[int]] | None = None
) -> DataFrame:
    """Lines with what they do to entries: ``_st`` starts one, ``_en`` ends one, ``_skip`` is blank."""
    schemas = as_list(schemas)
    groups = [schemas] if sets is None else [[schemas[i] for i in order] for order in sets]
    keys = ["source"] if sets is None else ["source", "schema_set"]
    return lines.select(*keys, "split", "pos", "value").withColumns(
        _flags(groups, F.lit(0) if sets is None else F.col("schema_set"))
    )


def fold_flagged(
    flagged: DataFrame,
    summary: DataFrame,
    scanned: bool = False,
    carry_rows: int = CARRY_ROWS,
    folded_lines: bool = False,
) -> DataFrame:
    """The second pass: entries of flagged lines, from the summary of their splits.

    With ``folded_lines`` a line whose ``pos`` is ``-n`` stands for ``n`` lines folded before,
    of which the summary counts the last only.
    """
    keys = [c for c in ("source", "schema_set") if c in flagged.columns]
    carry = stored(_carry(summary), "carry")
    if carry.count() <= carry_rows:
        carry = F.broadcast(carry)

    # Lines at the head of a split that continue an entry move to the split it began in.
    entered = flagged.join(carry, ["source", "split"], "left")
    if scanned:
        # Were files cut or numbered anew between the passes, summaries would be missing or lines
        # would lie outside theirs.
        lost = F.coalesce(~F.col("pos").between(F.col("_from"), F.col("_to")), F.col("split") > 0)
        text = F.when(lost, F.raise_error(F.lit("the splits of a file changed between two passes"))).otherwise(F.col("value"))
        entered = entered.withColumn("value", text)
    moved = (F.col("_owner").isNotNull()) & (F.col("_first").isNull() | (F.col("pos") < F.col("_first")))
    owned = entered.withColumn("_home", F.when(moved, F.col("_owner")).otherwise(F.col("split")))

    run = Window.partitionBy(*keys, "_home").orderBy("split", "pos")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(
        F.last("_after", ignorenulls=True).over(before), "_open", F.lit(False)
    )
    # The first entry of a split is known from the summary, whatever came before it.
    first = F.coalesce(F.col("pos") == F.col("_first"), F.lit(False))
    numbered = (
        owned.withColumn("_leads", first)
        .withColumn("_after", F.when(F.col("_leads"), ~F.col("_en")).otherwise(_after()))
        .withColumn("_is_open", F.col("_leads") & F.col("_skip") | state)
        .withColumn("_new", F.col("_leads") | _begins(F.col("_is_open")))
        .withColumn("_dropped", F.col("_skip") & ~F.col("_is_open"))
        .withColumn("_nth", F.sum(F.col("_new").cast("long")).over(run))
        .withColumn("_row", F.row_number().over(run).cast("long"))
        .filter(~F.col("_dropped"))
    )
    head, at = F.col("_new"), F.col("_row") + F.coalesce("_lines", F.lit(0))
    if folded_lines:
        at = at + F.when(F.col("pos") < 0, F.col("pos") + 1).otherwise(0)
    # Grouping keys extend the window's, so entries are joined where their lines already are.
    return (
        numbered.groupBy(*keys, "_home", "_nth")
        .agg(
            F.expr("listagg(value, '\n') within group (order by split, pos)").alias("raw"),
            F.max(F.when(head, at)).alias("line_no"),
            F.max(F.when(head, F.coalesce("_base", F.lit(0)))).alias("_base"),
        )
        .select(
            *keys,
            (F.col("_base") + F.col("_nth") - 1).alias("entry_index"),
            "line_no",
            "raw",
        )
    )


_SUMMARY = (
    "source string, split long, _n long, _from long, _to long, _leaves boolean, _new_open long, _new_shut long, "
    "_first_open long, _first_shut long, _row_open long, _row_shut long"
)


def _summary(flagged: DataFrame, scanned: bool) -> DataFrame:
    """One row per split: its lines, the state it leaves (null: as it was), and, entered with an
    entry open or shut, how many entries it begins and where the first one begins."""
    slim = flagged.select("source", "split", "pos", "_st", "_en", "_skip")
    if scanned:
        return slim.mapInArrow(_summaries, _SUMMARY)
    run = Window.partitionBy("source", "split").orderBy("pos")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    known = (
        slim.withColumn("_after", _after())
        .withColumn("_known", F.last("_after", ignorenulls=True).over(before))
        .withColumn("_row", F.row_number().over(run).cast("long"))
    )
    new = {
        case: _begins(F.coalesce("_known", F.lit(case == "open"))) for case in ("open", "shut")
    }
    return known.groupBy("source", "split").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("pos").alias("_from"),
        F.max("pos").alias("_to"),
        F.max_by("_after", F.when(F.col("_after").isNotNull(), F.col("_row"))).alias("_leaves"),
        *[F.count_if(test).alias(f"_new_{case}") for case, test in new.items()],
        *[F.min(F.when(test, F.col("pos"))).alias(f"_first_{case}") for case, test in new.items()],
        *[F.min(F.when(test, F.col("_row"))).alias(f"_row_{case}") for case, test in new.items()],
    )


def _summaries(batches):
    """Summaries of the splits of a scan, which come together and in order."""
    names = [c.split()[0] for c in _SUMMARY.split(",")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _SUMMARY.split(",")])
    held, done, seen = None, [], set()

    def close():
        same = held["state"]["open"] == held["state"]["shut"]
        done.append([held["source"], held["split"], held["n"], held["from"], int(held["at"]), held["state"]["open"] if same else None, *(held[k][c] for k in ("new", "first", "row") for c in ("open", "shut"))])

    for batch in batches:
        if not batch.num_rows:
            continue
        split, pos = batch.column("split").to_numpy(), batch.column("pos").to_numpy()
        st, en, skip = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_st", "_en", "_skip"))
        ends = pc.run_end_encode(batch.column("source")).run_ends.to_numpy()
        cuts = np.unique(np.r_[0, ends, 1 + np.flatnonzero(split[1:] != split[:-1])]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            key = (batch.column("source")[a].as_py(), int(split[a]))
            if held is None or (held["source"], held["split"]) != key:
                if held:
                    close()
                if key in seen:
                    raise ValueError(f"lines of {key} are not together; fold them without scanned")
                seen.add(key)
                none = {"open": None, "shut": None}
                held = {"source": key[0], "split": key[1], "n": 0, "from": int(pos[a]), "at": None, "state": {"open": True, "shut": False}, "new": {"open": 0, "shut": 0}, "first": dict(none), "row": dict(none)}
            if (np.diff(pos[a:b]) <= 0).any() or (held["at"] is not None and pos[a] <= held["at"]):
                raise ValueError(f"lines of {key} are not in order; fold them without scanned")
            for case, state in held["state"].items():
                begins, held["state"][case] = _walk(state, st[a:b], en[a:b], skip[a:b])
                where = np.flatnonzero(begins)
                held["new"][case] += len(where)
                if len(where) and held["first"][case] is None:
                    held["first"][case], held["row"][case] = int(pos[a + where[0]]), held["n"] + int(where[0]) + 1
            held["n"] += b - a
            held["at"] = pos[b - 1]
    if held:
        close()
    yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in done], schema)


def _walk(is_open: bool, st: np.ndarray, en: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, bool]:
    """Which lines begin an entry, and whether one is open after the last."""
    decides = ~skip | en
    last = np.maximum.accumulate(np.where(decides, np.arange(len(st)), -1))
    after = np.where(last >= 0, ~en[last] & ~skip[last], is_open)
    before = np.r_[is_open, after[:-1]]
    return (~before & ~skip) | (before & st), bool(after[-1])


def _entered(summary: DataFrame) -> DataFrame:
    """Summaries with how each split is entered, and what it then begins."""
    past = Window.partitionBy("source").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    entered = summary.withColumn("_open", F.coalesce(F.last("_leaves", ignorenulls=True).over(past), F.lit(False)))
    for name in ("_new", "_first", "_row"):
        entered = entered.withColumn(
            name, F.when(F.col("_open"), F.col(f"{name}_open")).otherwise(F.col(f"{name}_shut"))
        )
    return entered


def split_ends(summary: DataFrame) -> DataFrame:
    """``source, _lines, _entries, _open``: what each source has had after its last split, and
    whether its last entry is open."""
    return _entered(summary).groupBy("source").agg(
        F.sum("_n").alias("_lines"),
        F.sum("_new").alias("_entries"),
        F.max_by(F.coalesce("_leaves", "_open"), "split").alias("_open"),
    )


def _carry(summary: DataFrame) -> DataFrame:
    """One row per split of sources that have several: how it is entered and its offsets."""
    several = summary.withColumn("_splits", F.count(F.lit(1)).over(Window.partitionBy("source"))).filter("_splits > 1")
    past = Window.partitionBy("source").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    entered = _entered(several)
    begun = F.when(F.col("_new") > 0, F.col("split"))
    return entered.select(
        "source",
        "split",
        "_from",
        "_to",
        "_open",
        "_first",
        F.when(F.col("_open"), F.last(begun, ignorenulls=True).over(past)).alias("_owner"),
        F.coalesce(F.sum("_new").over(past), F.lit(0)).alias("_base"),
        # Lines before the first that stays here: earlier splits, and those moved away.
        (
            F.coalesce(F.sum("_n").over(past), F.lit(0))
            + F.when(F.col("_open"), F.coalesce(F.col("_row") - 1, F.lit(0))).otherwise(0)
        ).alias("_lines"),
    )


def fold_sample(
    lines: DataFrame, groups: list[list[LogSchema]], keys: Sequence[str], which: Column | None = None
) -> DataFrame:
    """Fold a few hundred leading lines per key; used by schema detection only."""
    flagged = lines.withColumns(_flags(groups, F.lit(0) if which is None else which))
    run = Window.partitionBy(*keys).orderBy("line_no")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        flagged.withColumn("_after", _after())
        .withColumn("_is_open", F.coalesce(F.last("_after", ignorenulls=True).over(before), F.lit(False)))
        .withColumn("_new", _begins(F.col("_is_open")))
        .withColumn("_nth", F.sum(F.col("_new").cast("long")).over(run))
        .filter(~(F.col("_skip") & ~F.col("_is_open")))
    )
    return numbered.groupBy(*keys, "_nth").agg(
        F.expr("listagg(value, '\n') within group (order by line_no)").alias("raw")
    )

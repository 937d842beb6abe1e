import random
import re

import pytest
from models import fold

from brackenlog.operators.fold import _SUMMARY, _summary, by_line_number, flagged_lines, fold_entries, fold_flagged, fold_sample
from brackenlog.plans.schema import LogSchema
from brackenlog.sources.files import read_lines

PLAIN = LogSchema("plain", "<a>: <b>")
START = LogSchema("start", "<a> <b>", entry_start=r"^S")
END = LogSchema("end", "<a> <b>", entry_end=r"E$")
BOTH = LogSchema("both", "<a> <b>", entry_start=r"^\s*\{", entry_end=r"^\s*\}")
BLANKS = LogSchema("blanks", "<a> <b>", entry_start=r"^\s*$", entry_end=r"^E")

CASES = {
    "none": ([], [], [], False),
    "derived": ([PLAIN], [r"^.+?: "], [], False),
    "start": ([START], [r"^S"], [], True),
    "end": ([END], [r"^.+? "], [r"E$"], True),
    "both": ([BOTH, START], [r"^\s*\{", r"^S"], [r"^\s*\}"], True),
    "blank_starts": ([BLANKS], [r"^\s*$"], [r"^E"], True),
}
WORDS = ["", " ", "S one", "x", "k: v", "{", "}", "a b", "a E", "E", "  ", "{ }"]


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("split_lines", [1, 2, 3, 1000])
def test_fold_equals_the_sequential_model(spark, case, split_lines):
    schemas, starts, ends, explicit = CASES[case]
    rng = random.Random(f"{case}")
    logs = {f"s{i}": rng.choices(WORDS, k=rng.randint(1, 14)) for i in range(40)}
    rows = [(s, no, v) for s, lines in logs.items() for no, v in enumerate(lines, 1)]
    rng.shuffle(rows)
    lines = spark.createDataFrame(rows, "source string, line_no long, value string")
    got = {}
    for r in fold_entries(by_line_number(lines, split_lines), schemas).collect():
        got.setdefault(r.source, []).append((r.entry_index, r.line_no, r.raw))
    for source, text in logs.items():
        want = fold(text, starts, ends, explicit, schemaless=not schemas)
        want = [(i, no, raw) for i, (no, raw) in enumerate(want)]
        assert sorted(got.get(source, [])) == want, (source, text)


def test_each_source_folds_under_its_own_set(spark):
    rows = [("a", 1, "S x"), ("a", 2, "y"), ("b", 1, "S x"), ("b", 2, "y: z"), ("b", 3, "w")]
    lines = by_line_number(spark.createDataFrame(rows, "source string, line_no long, value string"))
    lines = lines.selectExpr("*", "cast(source = 'b' as int) as schema_set")
    got = fold_entries(lines, [START, PLAIN], sets=[[0], [0, 1]]).orderBy("source", "entry_index").collect()
    assert [(r.source, r.schema_set, r.line_no, r.raw) for r in got] == [
        ("a", 0, 1, "S x\ny"),
        ("b", 1, 1, "S x"),
        ("b", 1, 2, "y: z\nw"),
    ]


@pytest.mark.parametrize("carry_rows,times", [(100, 1), (-1, 2)])
def test_fold_shuffles_the_text_once(spark, tmp_path, carry_rows, times):
    (tmp_path / "a.log").write_text("S x\ny\n" * 50)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in kept:
            spark.conf.set(k, "-1")
        folded = fold_entries(read_lines(spark, str(tmp_path / "a.log")), [START], scanned=True, carry_rows=carry_rows)
        explained = spark._jvm.PythonSQLUtils.explainString(folded._jdf.queryExecution(), "formatted")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    nodes = explained.split("\n\n")
    carrying = [n for n in nodes if re.match(r"\(\d+\) Exchange", n.strip()) and re.search(r"Input.*\bvalue#", n)]
    assert len(carrying) == times, explained


@pytest.mark.parametrize("case", ["derived", "both", "end"])
def test_files_fold_alike_however_they_are_cut(spark, tmp_path, case):
    schemas, starts, ends, explicit = CASES[case]
    rng = random.Random(case)
    logs = {f"f{i}.log": rng.choices(WORDS, k=400) for i in range(3)}
    for name, text in logs.items():
        (tmp_path / name).write_text("\n".join(text) + "\n")
    key, kept = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    results = []
    try:
        for size in ("64", "333", "1m"):
            spark.conf.set(key, size)
            rows = fold_entries(read_lines(spark, str(tmp_path)), schemas, scanned=True).collect()
            results.append(sorted((r.source.rsplit("/")[-1], r.entry_index, r.line_no, r.raw) for r in rows))
    finally:
        spark.conf.set(key, kept)
    want = sorted((name, i, no, raw) for name, text in logs.items() for i, (no, raw) in enumerate(fold(text, starts, ends, explicit)))
    assert all(found == want for found in results)


def test_files_cut_anew_between_the_passes_fail(spark, tmp_path):
    (tmp_path / "a.log").write_text("S x\ny\n" * 200)
    key, kept = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set(key, "300")
        found = _summary(flagged_lines(read_lines(spark, str(tmp_path)), [START]), True).collect()
        summary = spark.createDataFrame(found, _SUMMARY)
        spark.conf.set(key, "500")
        with pytest.raises(Exception, match="splits of a file changed"):
            fold_flagged(flagged_lines(read_lines(spark, str(tmp_path)), [START]), summary, True).collect()
    finally:
        spark.conf.set(key, kept)


def test_lines_out_of_order_are_not_taken_for_a_scan(spark):
    rows = [("a", 1, "S x"), ("b", 1, "y"), ("a", 2, "S z")]
    lines = by_line_number(spark.createDataFrame(rows, "source string, line_no long, value string").coalesce(1))
    with pytest.raises(Exception, match="not together"):
        fold_entries(lines, [START], scanned=True)
    lines = by_line_number(spark.createDataFrame([("a", 2, "S x"), ("a", 1, "y")], "source string, line_no long, value string").coalesce(1))
    with pytest.raises(Exception, match="not in order"):
        fold_entries(lines, [START], scanned=True)


def test_sample_fold(spark):
    rows = [("a", 1, "S x"), ("a", 2, ""), ("a", 3, "y"), ("a", 4, "S z")]
    lines = spark.createDataFrame(rows, "source string, line_no long, value string")
    assert sorted(r.raw for r in fold_sample(lines, [[START]], ["source"]).collect()) == ["S x\n\ny", "S z"]

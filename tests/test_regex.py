import pytest
from pyspark.sql import functions as F

from brackenlog.functions.regex import PatternError, escape, escape_col, to_java
from brackenlog.functions.text import (
    common_prefix_len, contains_ignore_case, is_blank, shape_of, strip_affix, trim_line_end,
)

# pattern, text, expected unanchored match in the source dialect
MATCHES = [
    (r"timed[[:space:]]*out", "timed  out", True),
    (r"timed[[:space:]]*out", "timedsout", False),
    (r"a[[:^digit:]]b", "axb", True),
    (r"a[[:^digit:]]b", "a1b", False),
    (r"(?P<a_b>x)y", "xy", True),
    (r"(?<n>x)+y", "xxy", True),
    (r"end$", "end\n", False),
    (r"(?m)end$", "end\nmore", True),
    (r"a.b", "a\rb", True),
    (r"a.b", "a\nb", False),
    (r"(?s)a.b", "a\nb", True),
    (r"^\d$", "٣", True),
    (r"\s", " ", True),
    (r"\bcaf\w\b", "café", True),
    (r"(?i)É", "é", True),
    (r"[]a]+$", "]a]", True),
    (r"a++", "aa", True),
    (r"^a{2,3}$", "aaaa", False),
    (r"x\{1\}", "x{1}", True),
    (r"\x41\x{42}\v", "AB\x0b", True),
    (r"[a-c&&[^b]]", "b", False),
    (r"\pL\p{Lu}", "aB", True),
    (r"a|b(?:c|d)", "bd", True),
    (r"}", "}", True),
]


@pytest.mark.parametrize("pattern,text,expected", MATCHES)
def test_translated_patterns_match_alike(spark, pattern, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.col("t").rlike(to_java(pattern))).first()[0] is expected


@pytest.mark.parametrize(
    "pattern",
    ["(unclosed", "closed)", "[a", "*a", "a|*", r"(?=x)", r"(?!x)", r"(?<=x)", r"(?<!x)", r"(a)\1",
     r"\k<a>", "a\\", r"\q", "a{", "a{3,2}", "[[:nope:]]", "(?>a)", r"\Z"],
)
def test_invalid_patterns_are_refused(pattern):
    with pytest.raises(PatternError):
        to_java(pattern)


def test_escape(spark):
    text = r"a.b+c*(d)?[e]{f}^$#&-~|\ g'"
    assert escape(text) == r"a\.b\+c\*\(d\)\?\[e\]\{f\}\^\$\#\&\-\~\|\\ g'"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(escape_col(F.col("t"))).first()[0] == escape(text)
    assert df.filter(F.col("t").rlike(to_java("^" + escape(text) + "$"))).count() == 1


def test_ignore_case_contains(spark):
    rows = [("Cache MISS",), ("CAFÉ",), ("Kelvin",), ("Dİsk",), (None,)]
    df = spark.createDataFrame(rows, "t string")

    def found(needle):
        return [r[0] for r in df.select(contains_ignore_case(F.col("t"), needle)).collect()]

    assert found("miss") == [True, False, False, False, False]
    assert found("é") == [False, True, False, False, False]
    assert found("k") == [False, False, False, True, False]  # the Kelvin sign is not a k
    assert found("di") == [False] * 5
    assert found("") == [True, True, True, True, False]


SHAPES = {
    "8ea1c0de-1111-2222-3333-444455556666": "uuid", "10.0.0.5": "ipv4", "010.0.0.255": "ipv4",
    "10.0.0.256": None, "1.2.3": None, "0x8F": "hex", "0x": None, "42": "integer", "1.5": "decimal",
    "1,5": "decimal", "800424FB": "bare_hex", "decade": None, "12345": "integer", "ab12": None,
    "'x=1'": "single_quoted", '"x"': "double_quoted", "'": None, "30s": None, "": None,
}


def test_shapes(spark):
    df = spark.createDataFrame([(t,) for t in SHAPES], "t string")
    got = {r.t: r.s for r in df.select("t", shape_of(F.col("t")).alias("s")).collect()}
    assert got == SHAPES


def test_small_text_functions(spark):
    df = spark.createDataFrame([("a\r\r\n", "(id=4,)", "abcd", "abxy", "  ")], "a string, b string, c string, d string, e string")
    row = df.select(
        trim_line_end(F.col("a")), strip_affix(F.col("b")), common_prefix_len(F.col("c"), F.col("d")),
        common_prefix_len(F.lit("ab"), F.lit("abc")), common_prefix_len(F.lit("x"), F.lit("x")),
        common_prefix_len(F.lit(""), F.lit("x")), common_prefix_len(F.lit("a"), F.lit("b")), is_blank(F.col("e")),
    ).first()
    assert tuple(row) == ("a", "id=4", 2, 2, 1, 0, 0, True)

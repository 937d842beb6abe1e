"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from brackenlog.functions.regex import escape, escape_col


def trim_line_end(line: Column) -> Column:
    """Drop every trailing CR and LF."""
    return F.rtrim(line, F.lit("\r\n"))


def head_line(raw: Column) -> Column:
    """First physical line of an entry."""
    return F.substring_index(raw, "\n", 1)


def is_blank(line: Column) -> Column:
    """Nothing but (Unicode) white space."""
    return ~line.rlike(r"(?U)\S")


def contains_ignore_case(text: Column, needle: str) -> Column:
    """Substring test that folds ASCII letters only, unless the needle itself is not ASCII."""
    if needle == "":
        return text.isNotNull()
    if not needle.isascii():
        return F.coalesce(F.lower(text).contains(needle.lower()), F.lit(False))
    folded = needle.lower()
    if "k" in folded or "i" in folded:
        # Full lower-casing maps the Kelvin sign to k and the dotted capital I to i.
        found = text.rlike("(?i)" + escape(needle))
    else:
        found = F.lower(text).contains(folded)
    return F.coalesce(found, F.lit(False))


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

# Shape classes of a variable token, tried in this order. Each has the test
# a token must pass and the pattern that stands for it in a template.
SHAPES = (
    ("uuid", r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
     r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    ("ipv4", rf"{_OCTET}(?:\.{_OCTET}){{3}}", r"\d{1,3}(?:\.\d{1,3}){3}"),
    ("hex", r"0[xX][0-9a-fA-F]+", r"0[xX][0-9a-fA-F]+"),
    ("integer", r"[0-9]+", r"\d+"),
    ("decimal", r"[0-9]+[.,][0-9]+", r"\d+[.,]\d+"),
    ("bare_hex", r"(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{6,}", r"[0-9a-fA-F]+"),
    ("single_quoted", r"'\S*'", r"'[^']*'"),
    ("double_quoted", r'"\S*"', r'"[^"]*"'),
)

# Punctuation that clings to a value without being part of it.
AFFIX = ",;:=()[]{}<>!?#"


def shape_test(token: Column, test: str) -> Column:
    return token.rlike(rf"(?s)\A(?:{test})\z")


def shape_of(token: Column) -> Column:
    """Name of the first shape the token has, or null."""
    out = None
    for name, test, _ in SHAPES:
        hit = shape_test(token, test)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def shape_mask(token: Column) -> Column:
    """Bit per shape the token has; tokens of a column share the shapes in the AND of theirs."""
    bits = None
    for i, (_, test, _) in enumerate(SHAPES):
        bit = F.when(shape_test(token, test), 1 << i).otherwise(0)
        bits = bit if bits is None else bits + bit
    # A word has no digit, quote or dash and needs one test instead of eight.
    return F.when(token.rlike("""[0-9'"-]"""), bits).otherwise(0)


def shape_in(mask: Column) -> Column:
    """Pattern of the first shape in a mask, or null."""
    out = None
    for i, (_, _, pattern) in enumerate(SHAPES):
        hit = mask.bitwiseAND(1 << i) != 0
        out = F.when(hit, pattern) if out is None else out.when(hit, pattern)
    return out


def strip_affix(token: Column) -> Column:
    """The token without clinging punctuation at either end."""
    cls = r"[,;:=()\[\]{}<>!?#]"
    return F.regexp_replace(token, rf"\A{cls}+|{cls}+\z", "")


def common_prefix_len(low: Column, high: Column) -> Column:
    """Characters shared at the start of two strings.

    For a set of strings, pass its minimum and maximum: what those two share, all share.
    """
    both = F.zip_with(F.split(low, ""), F.split(high, ""), lambda a, b: F.coalesce(a == b, F.lit(False)))
    cut = F.array_position(both, F.lit(False))
    return F.when((low == "") | (high == ""), 0).when(low == high, F.length(low)).otherwise(cut - 1).cast("int")


__all__ = [
    "AFFIX", "SHAPES", "common_prefix_len", "contains_ignore_case", "escape", "escape_col",
    "head_line", "is_blank", "shape_in", "shape_mask", "shape_of", "shape_test", "strip_affix", "trim_line_end",
]

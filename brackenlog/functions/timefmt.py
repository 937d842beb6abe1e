"""Event times: strftime-style formats, times sniffed off a line, and date text in bounds.

A time is a zone-less wall clock (``timestamp_ntz``). Formats are compiled to one regular
expression that rearranges the text into ISO order, and Spark's cast does the rest, so the
session time zone never enters.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, functions as F

from brackenlog.functions.regex import escape
from brackenlog.functions.text import head_line

MARK = "\u0001"
_MONTHS = " jan feb mar apr may jun jul aug sep oct nov dec"
_NUMBER = r"\s*(?<{0}>[0-9]{{1,2}})"

# Directive -> (pattern, part it fills). Groups are named after the part.
_DIRECTIVES = {
    "Y": r"\s*(?<Y>[0-9]{4})",
    "m": _NUMBER.format("m"),
    "d": _NUMBER.format("d"),
    "e": _NUMBER.format("d"),
    "H": _NUMBER.format("H"),
    "k": _NUMBER.format("H"),
    "M": _NUMBER.format("M"),
    "S": _NUMBER.format("S"),
    "f": r"\s*(?<f>[0-9]{1,6})",
    "3f": r"(?<f>[0-9]{3})",
    "6f": r"(?<f>[0-9]{6})",
    "9f": r"(?<f>[0-9]{6})[0-9]{3}",
    ".3f": r"\.(?<f>[0-9]{3})",
    ".6f": r"\.(?<f>[0-9]{6})",
    ".9f": r"\.(?<f>[0-9]{6})[0-9]{3}",
    ".f": r"(?:\.(?<f>[0-9]{1,6})[0-9]{0,3})?",
    "b": r"(?<b>[A-Za-z]{3})",
    "h": r"(?<b>[A-Za-z]{3})",
    "z": r"\s*[+-][0-9]{2}:?[0-9]{2}",
    ":z": r"\s*[+-][0-9]{2}:?[0-9]{2}",
    "a": r"[A-Za-z]{3}",
    "%": "%",
}
_COMPOUND = {"F": "%Y-%m-%d", "T": "%H:%M:%S", "R": "%H:%M"}
_ISO = re.compile(r"%Y-%m-%d(?P<sep>[ T])%H:%M:%S(?:(?P<dot>[.,])(?P<f>%f|%3f)|(?P<fixed>%\.3f))?")
_TOKEN = re.compile(r"%(\.?[369]?f|:z|[A-Za-z%])|(\s+)|([^%\s]+)")


def _compile(fmt: str) -> tuple[str, set[str]] | None:
    """Anchored Java pattern and the parts it captures; None for a format that never parses."""
    for short, long in _COMPOUND.items():
        fmt = fmt.replace("%" + short, long)
    pattern, parts, at = "", set(), 0
    while at < len(fmt):
        found = _TOKEN.match(fmt, at)
        if not found:
            return None
        directive, space, literal = found.groups()
        if directive is not None:
            if directive not in _DIRECTIVES:
                raise ValueError(f"time directive %{directive} is not supported")
            piece = _DIRECTIVES[directive]
            captured = set(re.findall(r"\?<([A-Za-z])>", piece))
            if captured & parts:
                return None
            pattern, parts = pattern + piece, parts | captured
        elif space is not None:
            pattern += r"\s+"
        else:
            pattern += escape(literal)
        at = found.end()
    return pattern, parts


def parse_time(text: Column, fmt: str) -> Column:
    """``text`` read by a strftime-style format, or null. Offsets are read and dropped."""
    compiled = _compile(fmt)
    null = F.lit(None).cast("timestamp_ntz")
    if compiled is None:
        return null
    pattern, parts = compiled
    if not {"Y", "d", "H", "M"} <= parts or not parts & {"m", "b"}:
        return null  # no full date and time of day: never an event time
    value = F.trim(text)
    iso = _ISO.fullmatch(fmt)
    if iso:
        # Already in the order the cast reads: the usual case needs a test, not a rewrite.
        digits = {"%f": "[0-9]{1,6}", "%3f": "[0-9]{3}", None: ""}[iso.group("f")]
        dot = escape(iso.group("dot") or "")
        if iso.group("fixed"):
            dot, digits = r"\.", "[0-9]{3}"
        shape = rf"\A[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{iso.group('sep')}[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}{dot}{digits}\z"
        plain = F.replace(text, F.lit(","), F.lit(".")) if dot == "," else text
        quick = F.when(text.rlike(shape), plain.try_cast("timestamp_ntz"))
    parsed = _rearranged(value, pattern, parts)
    if "%f" in fmt:
        # Seven to nine digits are a count of nanoseconds, not a left-aligned fraction.
        long = r"\A(.*[.,])([0-9]{7,9})([^.,0-9]*)\z"
        head, digits, tail = (F.regexp_extract(value, long, g) for g in (1, 2, 3))
        micros = F.substring(F.lpad(digits, 9, "0"), 1, 6)
        parsed = F.coalesce(
            parsed, F.when(digits != "", _rearranged(F.concat(head, micros, tail), pattern, parts))
        )
    return F.coalesce(quick, parsed) if iso else parsed


def _rearranged(value: Column, pattern: str, parts: set[str]) -> Column:
    month = "${m}" if "m" in parts else "${b}"
    seconds = "${S}" if "S" in parts else "00"
    fraction = ".${f}" if "f" in parts else ""
    iso = f"{MARK}${{Y}}-{month}-${{d}} ${{H}}:${{M}}:{seconds}{fraction}"
    moved = F.regexp_replace(value, rf"\A{pattern}\z", iso)
    moved = F.split_part(moved, F.lit(MARK), F.lit(2))
    if "m" not in parts:
        # The month name sits at a fixed place; transform() binds the text so it is built once.
        def numbered(text):
            number = F.instr(F.lit(_MONTHS), F.concat(F.lit(" "), F.lower(F.substring(text, 6, 3))))
            return F.concat(
                F.substring(text, 1, 5), ((number + 3) / 4).cast("int").cast("string"), text.substr(9, 40)
            )

        moved = F.transform(F.array(moved), numbered)[0]
    return moved.try_cast("timestamp_ntz")


_SNIFF = (
    r"(?s)\A[\s\[]*(?<Y>[0-9]{4})[-/](?<m>[0-9]{1,2})[-/](?<d>[0-9]{1,2})[T ]"
    r"(?<H>[0-9]{1,2}):(?<M>[0-9]{2}):(?<S>[0-9]{2})(?:[.,](?<f>[0-9]{1,6})[0-9]{0,3})?.*\z"
)


def sniff_time(raw: Column) -> Column:
    """The time at the head of a line, in the ISO family, or null."""
    iso = f"{MARK}${{Y}}-${{m}}-${{d}} ${{H}}:${{M}}:${{S}}.${{f}}"
    moved = F.regexp_replace(head_line(raw), _SNIFF, iso)
    return F.split_part(moved, F.lit(MARK), F.lit(2)).try_cast("timestamp_ntz")


# ---- date text in rules and searches (driver side) ----------------------------------

_DATE_TIMES = (
    r"(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})\.(\d{1,9})",
    r"(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})",
    r"(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{1,2})",
    r"(\d{4})/(\d{1,2})/(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})",
    r"(\d{4})-(\d{1,2})-(\d{1,2})",
    r"(\d{4})/(\d{1,2})/(\d{1,2})",
)
_TIMES = (r"(\d{1,2}):(\d{1,2}):(\d{1,2})\.(\d{1,9})", r"(\d{1,2}):(\d{1,2}):(\d{1,2})", r"(\d{1,2}):(\d{1,2})")


def parse_datetime(text: str) -> dt.datetime | None:
    """A date, or date and time, as typed in a bound. A bare time lands on 1900-01-01."""
    value = re.sub("[T_]", " ", text.strip().strip("'\""))
    if not value:
        return None
    for pattern in _DATE_TIMES:
        found = re.fullmatch(pattern, value, re.ASCII)
        if found:
            numbers = list(found.groups())
            micros = 0
            if len(numbers) == 7:
                digits = numbers.pop()
                micros = int(digits.ljust(6, "0")) if len(digits) <= 6 else int(digits) // 1000
            made = _made(*map(int, numbers), micros=micros)
            if made:
                return made
    for pattern in _TIMES:
        found = re.fullmatch(pattern, value, re.ASCII)
        if found:
            numbers = [int(n) for n in found.groups()]
            micros = numbers.pop() // 1000 if len(numbers) == 4 else 0
            made = _made(1900, 1, 1, *numbers, micros=micros)
            if made:
                return made
    return None


def _made(year, month, day, hour=0, minute=0, second=0, micros=0):
    try:
        return dt.datetime(year, month, day, hour, minute, second, micros)
    except ValueError:
        return None


def time_literal(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def parse_datetime_col(text: Column) -> Column:
    """``parse_datetime`` for a column of bounds."""
    value = F.regexp_replace(F.regexp_replace(F.trim(text), r"\A['\"]+|['\"]+\z", ""), "[T_]", " ")
    tries = [
        parse_time(value, fmt)
        for fmt in ("%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y/%m/%d %H:%M:%S")
    ]
    midnight = F.concat(value, F.lit(" 00:00"))
    tries += [parse_time(midnight, "%Y-%m-%d %H:%M"), parse_time(midnight, "%Y/%m/%d %H:%M")]
    # The digits after a bare time count nanoseconds; its places are not those of a decimal.
    digits = F.regexp_extract(value, r"\.([0-9]{1,9})\z", 1)
    places = F.substring(F.lpad(digits, 9, "0"), 1, 6)
    exact = F.concat(F.regexp_replace(value, r"\.[0-9]{1,9}\z", "."), places)
    tries.append(F.when(digits != "", parse_time(F.concat(F.lit("1900-01-01 "), exact), "%Y-%m-%d %H:%M:%S.%f")))
    of_day = F.concat(F.lit("1900-01-01 "), value)
    tries += [parse_time(of_day, "%Y-%m-%d %H:%M:%S"), parse_time(of_day, "%Y-%m-%d %H:%M")]
    return F.coalesce(*tries)

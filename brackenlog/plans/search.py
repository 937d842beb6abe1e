"""The search language compiled to a boolean column.

``word``  ``"two words"``  ``/regex/``  ``field=value``  ``field~text``  ``field=/regex/``
``after:time``  ``before:time``  ``date:[from..to]`` -- all terms must hold.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from brackenlog.functions.regex import PatternError, matches
from brackenlog.functions.text import contains_ignore_case
from brackenlog.functions.timefmt import parse_datetime
from brackenlog.operators.extract import Lookup
from brackenlog.plans.rules import within

_WORD = re.compile(
    r"""(?: '[^']*' | "(?:[^"\\]|\\.)*" | \\. | \\\Z | [^\s'"\\] )+""", re.VERBOSE | re.DOTALL
)
_PIECE = re.compile(r"""'([^']*)' | "((?:[^"\\]|\\.)*)" | \\(.?) | ([^'"\\]+)""", re.VERBOSE | re.DOTALL)
_FIELD = re.compile(r"([a-zA-Z_][a-zA-Z0-9_]*)([=~])(.*)", re.DOTALL)


@dataclass(frozen=True)
class Search:
    condition: Column
    errors: tuple[str, ...]
    terms: int


def words(text: str) -> list[str]:
    """Split like a shell does; text with an unbalanced quote is split on white space."""
    out, at = [], 0
    while True:
        at += len(text[at:]) - len(text[at:].lstrip())
        if at >= len(text):
            return out
        if text[at] == "#":
            newline = text.find("\n", at)
            if newline < 0:
                return out
            at = newline
            continue
        found = _WORD.match(text, at)
        if not found or (found.end() < len(text) and not text[found.end()].isspace()):
            return text.split()
        out.append("".join(map(_unquote, _PIECE.finditer(found.group()))))
        at = found.end()


def _unquote(piece: re.Match) -> str:
    single, double, escaped, plain = piece.groups()
    if double is not None:
        return re.sub(r'\\([$`"\\\n])', lambda m: "" if m.group(1) == "\n" else m.group(1), double)
    if escaped is not None:
        return "" if escaped == "\n" else escaped or "\\"
    return plain if plain is not None else single


def compile_search(text: str, fields: Lookup) -> Search:
    """Terms that cannot be read are reported and dropped; the others still apply."""
    condition, errors, terms = F.lit(True), [], 0
    for word in words(text):
        try:
            term = _term(word, fields)
        except (PatternError, ValueError) as error:
            errors.append(f"{word}: {error}")
            continue
        condition = term if terms == 0 else condition & term
        terms += 1
    return Search(condition, tuple(errors), terms)


def _term(word: str, fields: Lookup) -> Column:
    ts = F.col("ts")
    if word.startswith(("after:", "before:")):
        kind, _, body = word.partition(":")
        moment = parse_datetime(body)
        if moment is None:
            raise ValueError("unrecognised date")
        return within(ts, moment, None) if kind == "after" else within(ts, None, moment)
    if word.startswith("date:"):
        body = word[len("date:") :].strip().lstrip("[").rstrip("]")
        low, _, high = body.partition("..")
        low, high = parse_datetime(low), parse_datetime(high)
        if low is None and high is None:
            raise ValueError("empty date range")
        return within(ts, low, high)
    pair = _FIELD.fullmatch(word)
    if pair:
        name, op, value = pair.groups()
        if op == "~":
            return contains_ignore_case(fields(name), value.lower())
        if _is_regex(value):
            return matches(fields(name), value[1:-1], ignore_case=True)
        return fields(name) == value
    if _is_regex(word):
        return matches(F.col("raw"), word[1:-1], ignore_case=True)
    return contains_ignore_case(F.col("raw"), word.lower())


def _is_regex(text: str) -> bool:
    return len(text) >= 2 and text.startswith("/") and text.endswith("/")


def uses_fields(text: str) -> bool:
    """Whether the search reads parsed fields or times; one over raw text needs no parsing."""
    return any(w.startswith(("after:", "before:", "date:")) or _FIELD.fullmatch(w) for w in words(text))


def search(df: DataFrame, text: str, fields: Lookup) -> tuple[DataFrame, tuple[str, ...]]:
    """Matching entries, and the terms that were dropped."""
    found = compile_search(text, fields)
    return (df.filter(found.condition) if found.terms else df), found.errors


def mark(df: DataFrame, text: str, fields: Lookup, name: str = "is_match") -> DataFrame:
    """All entries with a flag; an empty search marks nothing."""
    found = compile_search(text, fields)
    blank = not text.strip()
    return df.withColumn(name, F.lit(False) if blank else found.condition)


def tag(df: DataFrame, searches: Mapping[str, str], fields: Lookup, name: str = "tags") -> DataFrame:
    """Names of the saved searches that match, as an array in library order."""
    named = [
        F.when(compile_search(text, fields).condition, F.lit(label)) for label, text in searches.items()
    ]
    return df.withColumn(name, F.array_compact(F.array(*named)))


def last_range(df: DataFrame, span: str) -> DataFrame:
    """Entries of the last ``span`` (``15 minutes``, ``1 hour``, ``7 days``), counted back from
    the newest entry of all sources. The newest time is one scalar, found by a sub-query."""
    newest = df.select(F.max("ts")).scalar()
    return df.filter(F.col("ts").between(newest - F.expr(f"INTERVAL {span}"), newest))

"""Log patterns are written in an RE2-like dialect; Spark runs Java's.

``to_java`` rewrites one into the other so that both match the same text, and raises
``PatternError`` on the driver for a pattern the dialect rejects. A bad pattern would
otherwise fail the whole job at run time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The characters that carry meaning in a pattern and are escaped in a literal.
META = "\\.+*?()|[]{}^$#&-~"

# ASCII classes written [:name:] inside a bracket.
ASCII_CLASSES = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": "\\x00-\\x7F",
    "blank": "\\t ",
    "cntrl": "\\x00-\\x1F\\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": "!-/:-@\\[-`{-~",
    "space": "\\t\\n\\x0B\\f\\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}

_COUNTED = re.compile(r"\{(\d+)(?:,(\d*))?\}")
_FLAGS = re.compile(r"\(\?([imsux]*)(?:-([imsux]+))?([:)])")
_NAMED = re.compile(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>")
_JAVA_FLAG = {"i": "iu", "m": "m", "s": "s", "x": "x", "u": "U"}


class PatternError(ValueError):
    """The pattern is not valid in the dialect."""


def escape(text: str) -> str:
    """Pattern matching ``text`` literally."""
    return "".join("\\" + c if c in META else c for c in text)


def escape_col(text: Column) -> Column:
    """``escape`` for a column."""
    return F.regexp_replace(text, r"([\\.+*?()|\[\]{}^$#&\-~])", r"\\$1")


def to_java(pattern: str, ignore_case: bool = False, dot_all: bool = False) -> str:
    """Java form of a whole pattern, with its leading flags."""
    body, unicode_classes = translate(pattern)
    flags = "d" + ("iu" if ignore_case else "") + ("s" if dot_all else "")
    return f"(?{flags}{'U' if unicode_classes else ''}){body}"


def translate(pattern: str) -> tuple[str, bool]:
    """Java body of ``pattern`` and whether it needs Unicode character classes.

    Captures become plain groups, so a caller can number its own groups around the body.
    """
    walk = _Walk(pattern)
    return walk.run(), walk.unicode


class _Walk:
    def __init__(self, pattern: str):
        self.p = pattern
        self.i = 0
        self.out: list[str] = []
        self.unicode = False

    def run(self) -> str:
        p = self.p
        groups: list[tuple[int, bool]] = []
        multiline = False
        atom = None  # where the last repeatable piece begins in ``out``
        repeated = False
        while self.i < len(p):
            c = p[self.i]
            counted = _COUNTED.match(p, self.i) if c == "{" else None
            if c in "*+?" or counted:
                if atom is None:
                    raise PatternError("nothing to repeat")
                if counted:
                    low, high = counted.group(1), counted.group(2)
                    if high and int(high) < int(low):
                        raise PatternError("repetition bounds out of order")
                token = counted.group(0) if counted else c
                if repeated:  # stacked repetition; Java would read it as possessive
                    self.out[atom:] = ["(?:", *self.out[atom:], ")"]
                self.i += len(token)
                if p.startswith("?", self.i):
                    token += "?"
                    self.i += 1
                self.out.append(token)
                repeated = True
                continue
            repeated = False
            start = len(self.out)
            if c == "(":
                flags = _FLAGS.match(p, self.i)
                named = _NAMED.match(p, self.i)
                if flags and (flags.group(1) or flags.group(2) or flags.group(3) == ":"):
                    on, off, end = flags.group(1), flags.group(2) or "", flags.group(3)
                    java = "".join(_JAVA_FLAG[f] for f in on)
                    java += "-" + "".join("U" if f == "u" else f for f in off) if off else ""
                    self.i = flags.end()
                    if end == ")":
                        multiline = ("m" in on or multiline) and "m" not in off
                        self.out.append(f"(?{java})")
                        atom = None
                        continue
                    groups.append((start, multiline))
                    multiline = ("m" in on or multiline) and "m" not in off
                    self.out.append(f"(?{java}:")
                elif named:
                    self.i = named.end()
                    groups.append((start, multiline))
                    self.out.append("(?:")
                elif p.startswith("(?", self.i):
                    raise PatternError("look-around and unknown group types are not supported")
                else:
                    self.i += 1
                    groups.append((start, multiline))
                    self.out.append("(?:")
                atom = None
            elif c == ")":
                if not groups:
                    raise PatternError("unopened group")
                atom, multiline = groups.pop()
                self.out.append(")")
                self.i += 1
            elif c == "|":
                self.out.append("|")
                self.i += 1
                atom = None
            elif c == "[":
                self.out.append(self._bracket())
                atom = start
            elif c == "\\":
                self.out.append(self._escaped(in_class=False))
                atom = start
            elif c == "$":
                self.out.append("$" if multiline else r"\z")
                self.i += 1
                atom = start
            elif c == "{":
                raise PatternError("unclosed or empty repetition")
            else:
                self.out.append(c)
                self.i += 1
                atom = start
        if groups:
            raise PatternError("unclosed group")
        return "".join(self.out)

    def _escaped(self, in_class: bool) -> str:
        p, at = self.p, self.i
        if at + 1 >= len(p):
            raise PatternError("trailing backslash")
        c = p[at + 1]
        self.i = at + 2
        if c in "dDsSwW":
            self.unicode = True
            return "\\" + c
        if c in "bB" and not in_class:
            self.unicode = True
            return "\\" + c
        if c in "Az" and not in_class:
            return "\\" + c
        if c in "ntrf":
            return "\\" + c
        if c == "v":
            return "\\x0B"
        if c == "a":
            return "\\x07"
        if c in "xuU":
            width = {"x": 2, "u": 4, "U": 8}[c]
            found = re.compile(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{%d})" % width).match(p, self.i)
            if not found:
                raise PatternError("bad hex escape")
            self.i = found.end()
            return "\\x{%s}" % (found.group(1) or found.group(2))
        if c in "pP":
            found = re.compile(r"\{\^?([A-Za-z_]+)\}|([A-Za-z])").match(p, self.i)
            if not found:
                raise PatternError("bad Unicode class")
            self.i = found.end()
            name = found.group(1) or found.group(2)
            return "\\%s{%s%s}" % (c, "" if len(name) <= 2 else "Is", name)
        if c.isalnum() or ord(c) > 127:
            raise PatternError(f"unknown escape \\{c}")
        return "\\" + c

    def _bracket(self) -> str:
        p = self.p
        self.i += 1
        out = ["["]
        if p.startswith("^", self.i):
            out.append("^")
            self.i += 1
        first = True
        while True:
            if self.i >= len(p):
                raise PatternError("unclosed bracket")
            c = p[self.i]
            if c == "]" and not first:
                self.i += 1
                out.append("]")
                return "".join(out)
            if c == "]":
                out.append("\\]")
                self.i += 1
            elif p.startswith("[:", self.i):
                end = p.find(":]", self.i)
                name = p[self.i + 2 : end] if end > 0 else ""
                negated, name = name.startswith("^"), name.lstrip("^")
                if name not in ASCII_CLASSES:
                    raise PatternError(f"unknown class [:{name}:]")
                out.append(f"[^{ASCII_CLASSES[name]}]" if negated else ASCII_CLASSES[name])
                self.i = end + 2
            elif c == "[":
                out.append(self._bracket())
            elif c == "\\":
                out.append(self._escaped(in_class=True))
            elif p.startswith("--", self.i) or p.startswith("~~", self.i):
                raise PatternError("class difference is not supported")
            else:
                out.append(c)
                self.i += 1
            first = False


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Unanchored test; a null text never matches."""
    return F.coalesce(text.rlike(to_java(pattern, ignore_case)), F.lit(False))

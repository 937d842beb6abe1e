"""A log schema: a ``<field>`` template turned into Spark column expressions.

``<name>`` captures a field, ``<name?>`` one that may be missing together with the literal
in front of it. The last field takes the rest of the line. Every field is a string; a field
that is missing, or belongs to a line the template does not match, is empty.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, functions as F

from brackenlog.functions.regex import escape, to_java, translate
from brackenlog.functions.text import head_line
from brackenlog.functions.timefmt import MARK

DEFAULT_TIME_FORMAT = "%Y-%m-%d %H:%M:%S.%f"
FILL = "\u0002"
_PLACEHOLDER = re.compile(r"<([a-zA-Z_][a-zA-Z0-9_]*)(\?)?>")

# Logical names and the field names that may stand behind them, in order.
ALIASES = {
    "level": ("log_level", "level", "severity"),
    "module": ("log_module", "module", "component"),
    "message": ("message", "msg"),
    "host": ("host",),
    "server": ("server",),
    "pid": ("process_id", "pid"),
    "thread": ("thread_id", "thr", "thread"),
    "file": ("file_name", "file"),
    "line": ("line_number", "line"),
    "timestamp": ("timestamp", "time", "ts"),
}
WHOLE_ENTRY = ("raw", "text", "any")
ORIGIN = ("source", "file_source")


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Sample:
    line: str
    level: str | None = None


@dataclass(frozen=True)
class _Slot:
    literal: str  # text between the previous field and this one
    name: str
    optional: bool


@dataclass(frozen=True)
class LogSchema:
    name: str
    template: str
    time_format: str = DEFAULT_TIME_FORMAT
    field_patterns: dict[str, str] = field(default_factory=dict, hash=False)
    entry_start: str = ""
    entry_end: str = ""
    samples: tuple[Sample, ...] = ()
    time_field: str = "timestamp"
    description: str = ""

    def __post_init__(self):
        names = self.fields
        if len(set(names)) != len(names):
            raise SchemaError(f"{self.name}: a field name appears twice")
        _ = self.full_pattern, self.start_pattern, self.end_pattern  # a bad pattern fails here

    # ---- shape of the template ------------------------------------------------------

    @cached_property
    def slots(self) -> tuple[_Slot, ...]:
        out, at = [], 0
        for found in _PLACEHOLDER.finditer(self.template):
            out.append(_Slot(self.template[at : found.start()], found.group(1), bool(found.group(2))))
            at = found.end()
        return tuple(out)

    @cached_property
    def trailer(self) -> str:
        """Literal text behind the last field."""
        ends = [found.end() for found in _PLACEHOLDER.finditer(self.template)]
        return self.template[ends[-1] if ends else 0 :]

    @cached_property
    def fields(self) -> tuple[str, ...]:
        return tuple(slot.name for slot in self.slots)

    @property
    def message_field(self) -> str:
        return self.fields[-1] if self.fields else "message"

    @property
    def has_tail(self) -> bool:
        """The last field is simply the rest of the line behind the header."""
        if not self.slots or self.trailer:
            return False
        last = self.slots[-1]
        return not last.optional and last.name not in self.field_patterns

    @property
    def is_block(self) -> bool:
        """One record spans several physical lines of the template."""
        return "\n" in self.template

    @property
    def level_field(self) -> str | None:
        return next((name for name in ALIASES["level"] if name in self.fields), None)

    @property
    def explicit_boundary(self) -> bool:
        return bool(self.entry_start.strip() or self.entry_end.strip())

    @property
    def specificity(self) -> int:
        """How much the template asserts: fields plus literal bytes."""
        named = sum(len(name) + 2 for name in self.fields)
        return len(self.fields) + max(len(self.template.encode()) - named, 0)

    def concrete(self, name: str) -> str | None:
        """The field behind a logical name."""
        return next((n for n in (name, *ALIASES.get(name, ())) if n in self.fields), None)

    # ---- patterns -------------------------------------------------------------------

    def _field_body(self, index: int) -> tuple[str, bool]:
        custom = self.field_patterns.get(self.slots[index].name)
        if custom is not None:
            return translate(custom)
        return (".*" if index == len(self.slots) - 1 else ".*?"), False

    def _assemble(self, header_only: bool, wanted=None) -> str:
        """Anchored Java pattern. Wanted fields are captured as f<position>."""
        body, unicode_classes = "", False
        for index, slot in enumerate(self.slots):
            inner, needs = self._field_body(index)
            unicode_classes |= needs
            literal = escape(slot.literal)
            if header_only and index == len(self.slots) - 1:
                body += literal
                break
            keep = wanted is None or slot.name in wanted
            group = f"(?<f{index}>{inner})" if keep else f"(?:{inner})"
            body += f"(?:{literal}{group})?" if slot.optional else literal + group
        else:
            body += escape(self.trailer)
        return f"(?ds{'U' if unicode_classes else ''})\\A{body}"

    def _header(self, wanted) -> str:
        """Pattern of the header with a fast form in front.

        A free field is the shortest text before the literal behind it. Where that literal
        holds a character the field does not, the two meet at one place only, and a greedy
        class finds it without trying every offset. The fast form (groups s<position>) takes
        lines where this holds for every field; others, and templates with patterns of
        their own, take the lazy form (groups f<position>), with the same result.
        """
        lazy = self._assemble(header_only=True, wanted=wanted)
        if self.field_patterns:
            return lazy
        body = ""
        for index, slot in enumerate(self.slots[:-1]):
            behind = self._literals_behind(index)
            stops = [c for c in behind[0] if all(c in text for text in behind)]
            stops.sort(key=lambda c: (c.isspace() or c.isalnum(), behind[0].index(c)))
            if not stops:
                return lazy
            keep = wanted is None or slot.name in wanted
            stop = "\\" + stops[0] if not stops[0].isalnum() and stops[0] != " " else stops[0]
            run = f"[^{stop}]*" + ("+" if all(text[0] == stops[0] for text in behind) else "")
            group = f"(?<s{index}>{run})" if keep else run
            literal = escape(slot.literal)
            if slot.optional:
                after = escape(behind[0])
                # Missing only where the lazy form could not find it further on either.
                body += f"(?:{literal}{group}(?={after})|(?!{literal}.*?{after}))"
            else:
                body += literal + group
        flags, _, rest = lazy.partition("\\A")
        return f"{flags}\\A(?:{body}{escape(self.slots[-1].literal)}|{rest})"

    def _literals_behind(self, index: int) -> list[str]:
        """Literals that may follow a field; several where optional fields come next."""
        out = []
        for slot in self.slots[index + 1 :]:
            out.append(slot.literal)
            if not slot.optional:
                break
        return out

    @cached_property
    def full_pattern(self) -> str:
        return self._assemble(header_only=False, wanted=())

    @cached_property
    def start_pattern(self) -> str:
        """Test for a physical line that begins an entry."""
        if self.entry_start.strip():
            return to_java(self.entry_start.strip())
        if len(self.slots) >= 2:
            first, second = self.slots[:2]
            if not (first.optional or second.optional) and second.literal:
                return f"(?d)\\A{escape(first.literal)}.+?{escape(second.literal)}"
        return self.full_pattern

    @cached_property
    def end_pattern(self) -> str | None:
        return to_java(self.entry_end.strip()) if self.entry_end.strip() else None

    def starts(self, line: Column) -> Column:
        return line.rlike(self.start_pattern)

    def ends(self, line: Column) -> Column:
        return line.rlike(self.end_pattern) if self.end_pattern else F.lit(False)

    def parses(self, raw: Column) -> Column:
        """The whole template matches (from the start of) the text."""
        return raw.rlike(self.full_pattern)

    # ---- extraction -----------------------------------------------------------------

    def cells(self, raw: Column, wanted=None) -> Column:
        """Array of the wanted fields (all by default), found in one regex pass.

        Element 0 is a placeholder and the last one the text behind the header. Where the
        template does not match, the array holds the text alone.
        """
        wanted = self.kept(wanted)
        cells = self._cells(head_line(raw), wanted, tail=self.has_tail)
        if self.is_block:
            return F.when(raw.contains("\n"), self._cells(raw, wanted, tail=False)).otherwise(cells)
        return cells

    def kept(self, wanted=None) -> list[str]:
        return [n for n in self.fields if wanted is None or n in wanted]

    def value(self, cells: Column, raw: Column, name: str, wanted=None) -> Column:
        """One field out of ``cells``; continuation lines belong to the last field."""
        kept = self.kept(wanted)
        if name not in kept:
            return F.lit("")
        found = F.get(cells, F.lit(kept.index(name) + 1))
        if name != self.message_field:
            return F.coalesce(found, F.lit(""))
        if not self.is_block:
            found = F.concat(found, raw.substr(F.length(head_line(raw)) + 1, F.length(raw)))
        return F.when(F.size(cells) > 1, found).otherwise(raw)

    def _cells(self, text: Column, wanted: list[str], tail: bool) -> Column:
        if tail and len(self.slots) == 1 and not self.slots[0].literal:
            return F.array(F.lit(""), text)  # the template is the message alone
        header = self._header(wanted) if tail else self._assemble(header_only=False, wanted=wanted)
        names = [n for n in wanted if not (tail and n == self.message_field)]
        forms = "sf" if "(?<s" in header else "f"
        refs = "".join(
            MARK + "".join(f"${{{form}{self.fields.index(n)}}}" for form in forms) for n in names
        )
        count = len(names) + 2
        fast = F.split(F.regexp_replace(text, header, refs + MARK), MARK, count)
        # A head that holds the marker itself gets one longer than any run in it.
        run = F.length(text) - F.length(F.replace(text, F.lit(FILL), F.lit(""))) + 1
        mark = F.concat(F.lit(MARK), F.repeat(F.lit(FILL), run), F.lit(MARK))
        own = F.regexp_replace(text, F.lit(header), F.replace(F.lit(refs + MARK), F.lit(MARK), mark))
        return F.when(text.contains(MARK), F.split(own, mark, F.lit(count))).otherwise(fast)

    # ---- a conjunction of fields as one pattern -------------------------------------

    def pinned_pattern(self, chosen: dict[str, str]) -> str | None:
        """Java pattern over the raw entry with the chosen fields held at their values.

        An optional field held at the empty value must be missing.
        """
        if not self.slots:
            return None
        body, unicode_classes = "", False
        for index, slot in enumerate(self.slots):
            literal = escape(slot.literal)
            value = chosen.get(slot.name)
            if value is None:
                inner, needs = self._field_body(index)
                unicode_classes |= needs
                body += f"(?:{literal}(?:{inner}))?" if slot.optional else f"{literal}(?:{inner})"
            elif value or not slot.optional:
                body += literal + escape(value)
        return f"(?ds{'U' if unicode_classes else ''})\\A{body}{escape(self.trailer)}"

    def pinned(self, raw: Column, chosen: dict[str, str]) -> Column:
        pattern = self.pinned_pattern(chosen)
        return F.lit(False) if pattern is None else raw.rlike(pattern)


__all__ = ["ALIASES", "LogSchema", "ORIGIN", "Sample", "SchemaError", "WHOLE_ENTRY"]

"""Message templates: what varies between two runs of a log statement gives way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brackenlog.functions.regex import escape_col
from brackenlog.functions.text import SHAPES

_CLING = r"[,;:=()\[\]{}<>!?#]"
# White space other than a blank cannot occur once runs of it are collapsed to one blank,
# so each of these can stand for a shape while the rest of the message is escaped.
_STAND_IN = ("\t", "\n", "\x0b", "\f", "\r", "\x85", "\u2028", "\u2029")
_IN_TOKEN = r"[^ \t\n\x0B\f\r\x{85}\x{2028}\x{2029}]"


def _value_pattern() -> str:
    """One pattern for every value of a message followed by a line feed and the stand-ins.

    Each shape, once its token is found to end there, looks ahead and captures its own
    stand-in, so that one replacement text serves all of them.
    """
    shapes = []
    for i, (_, test, _) in enumerate(SHAPES):
        test = test.replace(r"\S", _IN_TOKEN)
        own = rf"(?=[^\n]*+\n.{{{i}}}(?<m{i}>.))"
        shapes.append(rf"(?:{test})(?<t{i}>{_CLING}*)(?![^ \n]){own}")
    return rf"(?s)(?<![^ ])(?<h>(?:{_IN_TOKEN}*?{_CLING})??)(?:{'|'.join(shapes)})"


_VALUE = _value_pattern()
_VALUE_REPLACED = "${h}" + "".join(f"${{m{i}}}${{t{i}}}" for i in range(len(SHAPES)))


def squeeze(message: Column) -> Column:
    """White space trimmed and every run of it made one blank."""
    return F.trim(F.regexp_replace(message, r"(?U)\s+", " "))


def message_template(message: Column) -> Column:
    """Pattern of a single message; null for a blank one.

    A value is the longest tail of a token that has a known shape and begins the token or
    follows punctuation. Words stay as they are. A message of values alone stays literal.
    """
    bound = F.array(F.struct(message.alias("m"), squeeze(message).alias("p")))
    return F.get(F.transform(bound, lambda both: _template(both["m"], both["p"])), F.lit(0))


def _template(message: Column, plain: Column) -> Column:
    key_text = "\n" + "".join(_STAND_IN)
    marked = F.regexp_replace(F.concat(plain, F.lit(key_text)), _VALUE, _VALUE_REPLACED)
    marked = F.regexp_replace(marked, rf"(?s).{{{len(key_text)}}}\z", "")
    # Most messages of prose hold nothing that could be a value.
    marked = F.when(plain.rlike(r"""[0-9'"]|[0-9a-fA-F]{8}-"""), marked).otherwise(plain)
    pattern = F.get(F.transform(F.array(marked), lambda m: _pattern(m, message)), F.lit(0))
    return F.when(plain != "", pattern)


def _pattern(marked: Column, message: Column) -> Column:
    out = escape_col(marked)
    for stand_in, (_, _, pattern) in zip(_STAND_IN, SHAPES):
        out = F.replace(out, F.lit(stand_in), F.lit(pattern))
    out = F.replace(out, F.lit(" "), F.lit(r"\s+"))
    holds_text = marked.rlike(_IN_TOKEN)
    literal = escape_col(F.regexp_replace(message, r"(?U)\A\s+|\s+\z", ""))
    return F.when(holds_text, out).otherwise(literal)


def templates(df: DataFrame, message: Column, order: str) -> DataFrame:
    """Every template of a log with its count, time span and first example."""
    return (
        df.select(message_template(message).alias("template"), message.alias("_message"), "ts", order)
        .filter(F.col("template").isNotNull())
        .groupBy("template")
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.min_by("_message", order).alias("example"),
        )
    )

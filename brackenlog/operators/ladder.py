"""Patterns for groups of messages, from loose to exact.

Each group (``key``) is a selection of messages in an ``order``. The patterns are built
from aggregates over token columns; only the loose one, a fold in message order that is
not associative, runs in Python, streaming over sorted rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from brackenlog.functions.regex import escape_col
from brackenlog.functions.text import SHAPES, common_prefix_len, shape_in, shape_mask, shape_test
from brackenlog.operators.mining import message_template, squeeze

# Names of the rungs, loosest strategy first.
RUNGS = ("loose", "prefix", "wildcard", "typed", "exact")


def pattern_ladder(messages: DataFrame) -> DataFrame:
    """``key, rung, pattern`` for messages ``key, order, message``; equal patterns once.

    Also ``is_default``: typed, else loose if it carries half of the shortest message, else
    exact; no default for a single message.
    """
    texts = _texts(messages)
    width = F.when(F.col("text") == "", 0).otherwise(F.size(F.split(squeeze(F.col("text")), " ")))
    groups = texts.groupBy("key").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("texts"),
        F.min(width).alias("narrow"),
        F.max(width).alias("wide"),
        F.max(F.when(F.col("text") != "", F.col("text"))).alias("lone"),
    )
    tokens = texts.filter("text != ''").select("key", F.posexplode(F.split(squeeze(F.col("text")), " ")).alias("at", "token"))
    exact = _joined(texts)
    columns = _columns(tokens, groups)
    aligned = _aligned(columns)
    common = common_tokens(texts)
    wide = (
        groups.join(exact, "key")
        .join(aligned, "key", "left")
        .join(common, "key", "left")
        .withColumn("equal", F.col("narrow") == F.col("wide"))
    )
    loose_tokens = F.coalesce("common", F.array().cast("array<string>"))
    loose = F.when(
        F.size(loose_tokens) > 0, F.array_join(F.transform(loose_tokens, escape_col), ".*")
    )
    lone_text = F.col("lone")
    typed_lone = F.when(_keeps_text(lone_text), message_template(lone_text))
    is_lone = F.col("n") == 1
    rungs = {
        "loose": loose,
        "prefix": F.when(F.col("prefix") != "", F.concat("prefix", F.lit(".*"))),
        "wildcard": F.when(~is_lone & F.col("equal") & F.col("wildcard_text"), F.col("wildcard")),
        "typed": F.when(is_lone, typed_lone).when(F.col("equal") & F.col("typed_text"), F.col("typed")),
        "exact": F.concat(F.lit("(?:"), "exact", F.lit(")")),
    }
    enough = (F.col("narrow") > 0) & (F.size(loose_tokens) * 2 >= F.col("narrow"))
    default = F.coalesce("typed_p", F.when(enough, F.col("loose_p")), F.col("exact_p"))
    wide = wide.select("key", "n", "narrow", "common", *[c.alias(f"{r}_p") for r, c in rungs.items()])
    wide = wide.withColumn("default_p", F.when(F.col("n") > 1, default))
    rows = [
        F.struct(F.lit(i).alias("place"), F.lit(r).alias("rung"), F.col(f"{r}_p").alias("pattern"))
        for i, r in enumerate(RUNGS)
    ]
    return (
        wide.select("key", "default_p", F.inline(F.array(*rows)))
        .filter("pattern is not null")
        .groupBy("key", "pattern", "default_p")
        .agg(F.min_by("rung", "place").alias("rung"))
        .select("key", "rung", "pattern", F.coalesce(F.col("pattern") == F.col("default_p"), F.lit(False)).alias("is_default"))
    )


def _texts(messages: DataFrame) -> DataFrame:
    """Distinct trimmed messages of each group, with their first place and number."""
    return (
        messages.select("key", "order", F.regexp_replace("message", r"(?U)\A\s+|\s+\z", "").alias("text"))
        .groupBy("key", "text")
        .agg(F.min("order").alias("order"), F.count(F.lit(1)).alias("n"))
    )


def _joined(texts: DataFrame) -> DataFrame:
    escaped = texts.filter("text != ''").withColumn("text", escape_col(F.col("text")))
    return escaped.groupBy("key").agg(F.expr("listagg(text, '|') within group (order by `order`)").alias("exact"))


def exact_alternations(messages: DataFrame) -> DataFrame:
    """``key, exact``: the alternatives of the exact rung, without building the other rungs."""
    return _joined(_texts(messages))


def _keeps_text(text: Column) -> Column:
    """Whether some token of a lone message is not a bare value."""
    tests = "|".join(test for _, test, _ in SHAPES)
    return F.exists(F.split(squeeze(text), " "), lambda t: ~shape_test(t, tests))


def _columns(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per token position of a group: what its tokens have in common."""
    # Distinct tokens first: a shape is tested once for each, whatever the number of messages.
    tokens = tokens.groupBy("key", "at", "token").agg(F.count(F.lit(1)).alias("copies"))
    columns = tokens.groupBy("key", "at").agg(
        F.min("token").alias("low"),
        F.max("token").alias("high"),
        F.sum("copies").alias("filled"),
        F.bit_and(shape_mask(F.col("token"))).alias("mask"),
    ).withColumn("class", shape_in(F.col("mask")))
    columns = columns.join(groups.select("key", "texts", F.expr("narrow = wide").alias("equal")), "key")
    same = F.col("low") == F.col("high")

    # A column of mixed tokens without a shape may still be one with a constant head and
    # tail. Heads and tails travel with the rows, so that each step reads only the last.
    open_columns = columns.filter(F.col("equal") & ~same & F.col("class").isNull()).select(
        "key",
        "at",
        common_prefix_len(F.col("low"), F.col("high")).alias("cut"),
        F.col("low").alias("sample"),
    )
    tails = tokens.join(open_columns, ["key", "at"]).select(
        "key",
        "at",
        F.expr("substring(sample, 1, cut)").alias("head"),
        F.reverse(F.expr("substring(token, cut + 1)")).alias("tail"),
    )
    feet = (
        tails.groupBy("key", "at")
        .agg(F.min("tail").alias("low"), F.max("tail").alias("high"))
        .select("key", "at", "low", common_prefix_len(F.col("low"), F.col("high")).alias("foot"))
    )
    cores = tails.join(feet, ["key", "at"]).select(
        "key",
        "at",
        "head",
        F.reverse(F.expr("substring(low, 1, foot)")).alias("foot_text"),
        F.reverse(F.expr("substring(tail, foot + 1)")).alias("core"),
    )
    affixed = (
        cores.groupBy("key", "at")
        .agg(
            F.bit_and(shape_mask(F.col("core"))).alias("core_mask"),
            F.any_value("head").alias("head"),
            F.any_value("foot_text").alias("foot_text"),
        )
        .select("key", "at", "head", "foot_text", shape_in(F.col("core_mask")).alias("core_class"))
        .filter("core_class IS NOT NULL")
    )
    columns = columns.join(affixed, ["key", "at"], "left")
    literal = escape_col(F.col("low"))
    wrapped = F.concat(escape_col(F.col("head")), "core_class", escape_col(F.col("foot_text")))
    return columns.select(
        "key",
        "at",
        ((same) & (F.col("filled") == F.col("texts"))).alias("shared"),
        literal.alias("literal"),
        F.when(same, literal).otherwise(F.lit(r"\S+")).alias("wildcard"),
        same.alias("wildcard_text"),
        F.when(same, literal)
        .when(F.col("class").isNotNull(), F.col("class"))
        .when(F.col("core_class").isNotNull(), wrapped)
        .otherwise(F.lit(r"\S+"))
        .alias("typed"),
        (
            same
            | F.coalesce(
                F.col("class").isNull() & F.col("core_class").isNotNull() & ((F.col("head") != "") | (F.col("foot_text") != "")),
                F.lit(False),
            )
        ).alias("typed_text"),
    )


def _aligned(columns: DataFrame) -> DataFrame:
    """Token positions joined to patterns; a group has as many as its longest message."""
    first_gap = F.min(F.when(~F.col("shared"), F.col("at")))
    joined = columns.groupBy("key").agg(
        first_gap.alias("gap"),
        F.expr(r"listagg(wildcard, '\\s+') within group (order by at)").alias("wildcard"),
        F.expr(r"listagg(typed, '\\s+') within group (order by at)").alias("typed"),
        F.bool_or("wildcard_text").alias("wildcard_text"),
        F.bool_or("typed_text").alias("typed_text"),
        F.array_sort(F.collect_list(F.struct("at", "literal"))).alias("literals"),
    )
    shared = F.filter("literals", lambda c: F.col("gap").isNull() | (c["at"] < F.col("gap")))
    return joined.withColumn(
        "prefix", F.array_join(F.transform(shared, lambda c: c["literal"]), r"\s+")
    ).drop("literals", "gap")


# ---- tokens common to all messages, in order ----------------------------------------


def common_tokens(texts: DataFrame) -> DataFrame:
    """``key, common``: the longest common subsequence folded over the distinct messages.

    A repeated message cannot change the fold, so distinct texts suffice. Rows arrive
    sorted, and only the tokens still common are held, never a whole group.
    """
    ordered = texts.select(
        F.col("key"),
        squeeze(F.col("text")).alias("plain"),
        "order",
    )
    key_type = texts.schema["key"].dataType.simpleString()
    return (
        ordered.repartition("key")
        .sortWithinPartitions("key", "order")
        .select("key", "plain")
        .mapInPandas(_fold_common, f"key {key_type}, common array<string>")
    )


def _fold_common(frames):
    key, common = None, None
    for frame in frames:
        done = []
        for row_key, plain in zip(frame["key"], frame["plain"]):
            if common is not None and row_key == key and not common:
                continue
            tokens = plain.split(" ") if plain else []
            if common is None or row_key != key:
                if common is not None:
                    done.append((key, common))
                key, common = row_key, tokens
            elif not _holds(tokens, common):
                common = longest_common(common, tokens)
        if done:
            yield pd.DataFrame(done, columns=["key", "common"])
    if common is not None:
        yield pd.DataFrame([(key, common)], columns=["key", "common"])


def _holds(tokens: list, common: list) -> bool:
    """Whether all of ``common`` is in ``tokens`` in its order; then it is their longest."""
    rest = iter(tokens)
    return all(t in rest for t in common)


def longest_common(left: list, right: list) -> list:
    """Longest common subsequence; among equals, tokens of ``left`` are skipped first.

    ``kept[i]`` holds, for every tail of ``right``, how much of it the tail ``left[i:]`` shares.
    A row follows from the next one by a running maximum, so only rows are looped over.
    """
    codes: dict = {}
    x, y = (np.array([codes.setdefault(t, len(codes)) for t in tokens], np.int64) for tokens in (left, right))
    kept = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        reach = np.where(y == x[i], kept[i + 1, 1:] + 1, kept[i + 1, :-1])
        kept[i, :-1] = np.maximum.accumulate(reach[::-1])[::-1]
    out, j = [], 0
    for i, token in enumerate(left):
        # Of what is left of ``right``, the first place that this token takes or may be skipped at.
        takes = y[j:] == x[i]
        stops = np.flatnonzero(takes | (kept[i + 1, j:-1] >= kept[i, j + 1 :]))
        if not len(stops):
            break
        j += int(stops[0])
        if takes[stops[0]]:
            out.append(token)
            j += 1
    return out


def rank_ladder(ladder: DataFrame, messages: DataFrame) -> DataFrame:
    """Rungs with the number of messages of their group each one matches."""
    hit = F.regexp_like("message", F.concat(F.lit("(?dU)"), F.col("pattern")))
    return (
        messages.select("key", "message")
        .join(ladder, "key")
        .groupBy("key", "rung", "pattern", "is_default")
        .agg(F.count_if(hit).alias("hits"))
    )

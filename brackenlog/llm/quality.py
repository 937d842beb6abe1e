"""Quality rules whose thresholds adapt to each language and source.

Every document is measured once. Mergeable quantile sketches of the measures are built for
each (language, source), merged into one for each language and one for all, and give outlier
fences that replace fixed cutoffs: a clean source gets narrow ones, a source of tables wide ones.
Documents are then joined with the fences of their group. Sketches count values in buckets, so
they are the same however rows are dealt, and a rerun judges alike.

The sketches aggregate before the shuffle, so a source with a third of all rows sends one
sketch per task. Measures are a few numbers per row and are written once to the shared folder,
because both the sketches and the join read them. The join carries no hint: Spark broadcasts
the fences if their real size allows and splits a skewed group otherwise.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from brackenlog.llm.components import stored
from brackenlog.llm.tokens import Fingerprints, column_bytes, mixed, rolling, runs
from brackenlog.session import fresh_dir

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Bytes that do not begin a code point of a word.
NO_WORD = SPACES + bytes(range(0x80, 0xC0))
REPEAT_WINDOW = 5
FLUSH_WORDS = 1_000_000
#: Relative error of a quantile.
ACCURACY = 0.005
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: The bucket of zero.
ZERO = -1_000_000
#: A group with fewer documents uses its language's fences, a language with fewer those of all.
LEAST_DOCS = 40
#: Fences lie this many interquartile ranges outside the quartiles; a range counts at least as the
#: measure's slack, as a group without any spread says nothing about the next document.
REACH = 3.0
#: A quarter of junk or more widens a group's quartiles. So its fence is no farther out than that of
#: all documents, or this many ranges between its median and the quartile on the other side.
HALVES = 6.0
#: Measures with their slack, and whether they are judged on the low side too.
MEASURES = {"symbol_rate": (0.03, False), "dup_line_rate": (0.1, False), "repeat_rate": (0.06, False), "mean_word": (1.0, True)}

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _repeated(prints: list[np.ndarray]) -> list[int]:
    """For each document, the words inside windows that it holds twice or more; there may be no document."""
    lengths = np.array([len(p) for p in prints], np.int64)
    values = np.concatenate(prints) if prints else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(prints), dtype=np.uint64), lengths)
    count = len(values) - REPEAT_WINDOW + 1
    hits = np.zeros(len(values) + 1, np.int32)
    if count > 0:
        whole = doc[:count] == doc[REPEAT_WINDOW - 1 :]
        at = np.flatnonzero(whole)
        key = mixed(rolling(values, REPEAT_WINDOW)[at] ^ mixed(doc[at] + np.uint64(1)))
        order = np.argsort(key)
        begins = runs(key[order])
        often = np.repeat(np.diff(np.r_[begins, len(at)]) > 1, np.diff(np.r_[begins, len(at)]))
        starts = at[order[often]]
        hits[starts] += 1
        np.add.at(hits, starts + REPEAT_WINDOW, -1)
    # A window ends inside its own document, so the running sum is 0 at every border.
    covered = np.cumsum(hits[:-1]) > 0
    return np.bincount(doc[covered].astype(np.int64), minlength=len(prints)).tolist()


def _counts(batches):
    memo = Fingerprints()
    for batch in batches:
        rows, prints, held, repeats = [], [], 0, []
        for text in column_bytes(batch, "text"):
            text = text or b""
            words = text.split()
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            rows.append((len(words), len(text.translate(None, NO_WORD)), len(text) - len(text.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines))))
            prints.append(memo.of(words))
            held += len(words)
            if held >= FLUSH_WORDS:
                repeats.append(_repeated(prints))
                prints, held = [], 0
        repeats.append(_repeated(prints))
        columns = [*zip(*rows), list(chain.from_iterable(repeats))] if rows else [[]] * 6
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in columns)], [*batch.schema.names[:-1], *COUNTS])


def measure(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The columns ``keys`` with the counts of each whole text; all are 0 for a null text."""
    given = docs.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), F.col("text").cast("string").alias("text"))
    shape = ", ".join([*(f"_k{i} {t.dataType.simpleString()}" for i, t in enumerate(given.schema.fields[:-1])), *(f"{c} long" for c in COUNTS)])
    found = given.mapInArrow(_counts, shape)
    return found.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), *COUNTS)


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def _with_measures(counts: DataFrame) -> DataFrame:
    return (
        counts.withColumn("symbol_rate", _share("n_symbols", "n_words"))
        .withColumn("dup_line_rate", _share("n_dup_lines", "n_lines"))
        .withColumn("repeat_rate", _share("n_repeat_words", "n_words"))
        .withColumn("mean_word", _share("word_chars", "n_words"))
    )


def _bucket(value: Column) -> Column:
    return F.when(value <= 0, F.lit(ZERO)).otherwise(F.ceil(F.log(value) / F.lit(math.log(GAMMA)))).cast("int")


def _at(bucket: Column) -> Column:
    """The value in the middle of a bucket."""
    return F.when(bucket == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), bucket) * (2 / (GAMMA + 1)))


def sketches(measured: DataFrame) -> DataFrame:
    """Quantile sketches of all groups: ``lang, source, measure, bucket, n``.

    A sketch counts values in buckets whose width grows with the value, so its quantiles have a
    relative error of ``ACCURACY``, and a measure has some thousand buckets at most. Sketches of
    groups are merged by adding counts, in any order and to the same sketch.
    """
    each = F.array(*(F.struct(F.lit(m).alias("measure"), _bucket(F.col(m)).alias("bucket")) for m in MEASURES))
    rows = measured.where("n_words > 0").select("lang", "source", F.explode(each).alias("m"))
    return rows.groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n`` and the quartiles ``<measure>_q1, _q2, _q3`` of sketches merged by ``keys``."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*keys, "measure")
    merged = merged.withColumn("_to", F.sum("n").over(own.orderBy("bucket"))).withColumn("_all", F.sum("n").over(own))
    found = [
        _at(F.min(F.when((F.col("measure") == m) & (F.col("_to") >= q * F.col("_all")), F.col("bucket")))).alias(f"{m}_{name}")
        for m in MEASURES
        for name, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))
    ]
    return merged.groupBy(*keys).agg(F.max("_all").alias("n"), *found)


def fences(sketch: DataFrame) -> DataFrame:
    """``lang, source`` with ``<measure>_low`` and ``<measure>_high``, from merged sketches."""

    def prefixed(df, p):
        return df.select(*(F.col(c).alias(c if c in ("lang", "source") else p + c) for c in df.columns))

    by_lang = prefixed(quartiles(sketch, ["lang"]), "l_").withColumnRenamed("lang", "l_lang")
    rows = prefixed(quartiles(sketch, ["lang", "source"]), "g_").join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    # One row.
    rows = rows.join(F.broadcast(prefixed(quartiles(sketch, []), "a_")))
    out = ["lang", "source"]
    for m, (slack, both) in MEASURES.items():
        q1, q2, q3 = (F.when(F.col("g_n") >= LEAST_DOCS, F.col(f"g_{m}_{q}")).when(F.col("l_n") >= LEAST_DOCS, F.col(f"l_{m}_{q}")).otherwise(F.col(f"a_{m}_{q}")) for q in ("q1", "q2", "q3"))
        reach = REACH * F.greatest(q3 - q1, F.lit(slack))
        everywhere = REACH * F.greatest(F.col(f"a_{m}_q3") - F.col(f"a_{m}_q1"), F.lit(slack))
        high = F.least(q3 + reach, F.greatest(F.col(f"a_{m}_q3") + everywhere, q2 + HALVES * (q2 - q1)))
        low = F.greatest(q1 - reach, F.least(F.col(f"a_{m}_q1") - everywhere, q2 - HALVES * (q3 - q2)))
        out.append(high.alias(f"{m}_high"))
        out.append(low.alias(f"{m}_low") if both else F.lit(float("-inf")).alias(f"{m}_low"))
    return rows.select(*out)


def judge(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, lang, source``, the counts, ``base_failed``, the measures and ``kept``.

    Defined cases: a null or empty text has counts of 0 and fails the base rule, and its group
    may have no fences. Null languages and sources form groups of their own. Repeated rows are
    judged alike. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = fresh_dir(spark, "quality")
    measure(docs, [id_column, "lang", "source"]).write.parquet(folder)
    measured = _with_measures(spark.read.parquet(folder))
    sketch = stored(sketches(measured), "quality-sketches")
    limits = fences(sketch).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True))
    return joined.select(id_column, "lang", "source", *COUNTS, *MEASURES, base_failed.alias("base_failed"), (~base_failed & inside).alias("kept"))

"""Substring deduplication: words in windows that also start in an earlier document go.

Every window of ``window`` words gets a Rabin-Karp hash. Windows are grouped by hash and the
smallest document that holds one owns it; every other document loses the words of that window.
Windows found repeated merge into maximal intervals per document.

How the work is split:

* Documents are dealt by a hash of their id once. Both the hashing of windows and the final
  removal read that one exchange, so text moves once.
* A task keeps, of all windows it has seen with one hash, only those of its smallest document;
  the others are repeated for certain and need no shuffle. So a window that a third of all
  documents holds reaches its bucket as one row per task.
* Windows are shuffled as packed arrays, by buckets of a second polynomial. Two windows are
  taken as equal if both the 64 bits of the first hash and the bucket of the second agree, so
  the width grows with the number of buckets.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from brackenlog.llm.tokens import BASES, Fingerprints, column_bytes, mixed, release, releasing, rolling, runs
from brackenlog.session import shuffle_width

WINDOW = 13
FLUSH_WORDS = 500_000
#: Characters of text for each bucket of windows and each two groups of documents.
BUCKET_CHARS = 5_000_000
NO_ID = np.iinfo(np.int64).max


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one block. Hashes do not compress; all others do."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        raw = a.tobytes()
        body = raw if a.dtype == np.uint64 else zstandard.compress(raw, 1)
        out += [struct.pack("<2sI", a.dtype.str[1:].encode(), len(body)), body]
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 4
    for _ in range(struct.unpack_from("<I", blob)[0]):
        kind, size = struct.unpack_from("<2sI", blob, at)
        body, at = blob[at + 6 : at + 6 + size], at + 6 + size
        out.append(np.frombuffer(body if kind == b"u8" else zstandard.decompress(body), f"<{kind.decode()}"))
    return out


def _by_document(dest, doc_id, ordinal, pos):
    """Rows ``dest, blob`` of marked window starts, one per destination. Sorts its input."""
    order = np.lexsort((pos, ordinal, doc_id, dest))
    dest, doc_id, ordinal, pos = (a[order] for a in (dest, doc_id, ordinal, pos))
    begins = runs(dest)
    for a, b in zip(begins, np.r_[begins[1:], len(dest)]):
        part = slice(a, b)
        heads = np.flatnonzero(np.r_[True, (doc_id[part][1:] != doc_id[part][:-1]) | (ordinal[part][1:] != ordinal[part][:-1])])
        counts = np.diff(np.r_[heads, b - a]).astype(np.uint32)
        yield int(dest[a]), _pack(doc_id[part][heads], ordinal[part][heads], counts, np.diff(pos[part], prepend=np.uint32(0)))


def _marks(blobs: list[bytes]):
    """Marked window starts as parallel arrays of id, ordinal and position."""
    cols = [[], [], []]
    for blob in blobs:
        ids, ordinals, counts, steps = _unpack(blob)
        for col, a in zip(cols, (np.repeat(ids, counts), np.repeat(ordinals, counts), np.cumsum(steps, dtype=np.uint32))):
            col.append(a)
    return [np.concatenate(c) for c in cols] if blobs else [np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint32)]


def _ordinals(ids: list) -> Iterator[int]:
    """Numbers rows of one id, which stand together in sorted order."""
    last, n = object(), 0
    for i in ids:
        n = n + 1 if i == last else 0
        last = i
        yield n


def _windows(window: int, buckets: int):
    def flush(prints, lengths, docs):
        values, lengths = np.concatenate(prints), np.array(lengths)
        ids, ordinals, dests = (np.array(c, t) for c, t in zip(zip(*docs), (np.int64, np.uint32, np.int32)))
        starts = np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)
        pos = (np.arange(len(values)) - starts[doc]).astype(np.uint32)
        count = len(values) - window + 1
        inside = doc[:count] == doc[window - 1 :]
        h = mixed(rolling(values, window))[inside]
        bucket = (mixed(rolling(values, window, BASES[1]))[inside] % np.uint64(buckets)).astype(np.uint32)
        doc, pos = doc[:count][inside], pos[:count][inside]
        rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)[doc]
        order = np.argsort(h)
        begins = runs(h[order])
        least = np.repeat(np.minimum.reduceat(rank[order], begins), np.diff(np.r_[begins, len(h)]))
        repeated = np.empty(len(h), bool)
        repeated[order] = rank[order] > least
        if repeated.any():
            d = doc[repeated]
            for dest, blob in _by_document(dests[d], ids[d], ordinals[d], pos[repeated]):
                yield dest % buckets, dest, blob
        kept = np.flatnonzero(~repeated)
        kept = kept[np.argsort(bucket[kept], kind="stable")]
        begins = runs(bucket[kept])
        for a, b in zip(begins, np.r_[begins[1:], len(kept)]):
            rows = kept[a:b]
            d = doc[rows]
            heads = runs(d)
            here = d[heads]
            counts = np.diff(np.r_[heads, len(d)]).astype(np.uint32)
            place = pos[rows]
            steps = np.diff(place, prepend=np.uint32(0))
            yield int(bucket[rows[0]]), None, _pack(h[rows], ids[here], ordinals[here], dests[here], counts, steps)

    def table(rows):
        return pa.RecordBatch.from_pydict(
            {"bucket": [r[0] for r in rows], "dest": [r[1] for r in rows], "blob": [r[2] for r in rows]},
            pa.schema([("bucket", pa.int32()), ("dest", pa.int32()), ("blob", pa.binary())]),
        )

    def sent(rows):
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[2])
            if size > 8 << 20:
                yield table(held)
                held, size = [], 0
        if held:
            yield table(held)

    @releasing
    def run(batches):
        memo, prints, lengths, docs, total, last = Fingerprints(), [], [], [], 0, None
        for batch in batches:
            ids, dests = batch.column("doc_id").to_pylist(), batch.column("dest").to_pylist()
            for i, dest, text in zip(ids, dests, column_bytes(batch, "text")):
                ordinal = last[1] + 1 if last and last[0] == i and last[2] == dest else 0
                last = i, ordinal, dest
                words = text.split() if text else ()
                if len(words) < window:
                    continue
                prints.append(memo.of(words))
                lengths.append(len(words))
                docs.append((NO_ID if i is None else i, ordinal, dest))
                total += len(words)
                if total >= FLUSH_WORDS:
                    yield from sent(flush(prints, lengths, docs))
                    prints, lengths, docs, total = [], [], [], 0
        if docs:
            yield from sent(flush(prints, lengths, docs))

    return run


def _owned(table: pa.Table) -> pa.Table:
    """Marks of one bucket: windows whose hash a smaller document holds too."""
    out, cols = [], [[] for _ in range(5)]
    for dest, blob in zip(table.column("dest").to_pylist(), table.column("blob").to_pylist()):
        if dest is not None:
            out.append((dest, blob))
            continue
        h, ids, ordinals, dests, counts, steps = _unpack(blob)
        for col, a in zip(cols, (h, *(np.repeat(c, counts) for c in (ids, ordinals, dests)), np.cumsum(steps, dtype=np.uint32))):
            col.append(a)
    if cols[0]:
        h, ids, ordinals, dests, pos = (np.concatenate(c) for c in cols)
        order = np.argsort(h)
        begins = runs(h[order])
        least = np.repeat(np.minimum.reduceat(ids[order], begins), np.diff(np.r_[begins, len(h)]))
        found = order[ids[order] > least]
        out += _by_document(dests[found], ids[found], ordinals[found], pos[found]) if len(found) else []
    return pa.table({"dest": pa.array([r[0] for r in out], pa.int32()), "blob": pa.array([r[1] for r in out], pa.binary())})


def _bucket(table: pa.Table) -> pa.Table:
    try:
        return _owned(table)
    finally:
        release()


def intervals(starts: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Covered words as a mask, and the maximal intervals ``[start, end)`` as rows."""
    flags = np.zeros(n + 1, np.int32)
    flags[starts] = 1
    total = np.cumsum(flags)
    covered = total[:n] - np.r_[np.zeros(min(window, n), np.int32), total[: max(0, n - window)]] > 0
    edges = np.diff(np.r_[False, covered, False].astype(np.int8))
    return covered, np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], 1)


_FOUND = [
    ("n_words", pa.int64()),
    ("n_removed", pa.int64()),
    ("intervals", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("kept_text", pa.string()),
]


def _removed(window: int, rejoin: bool):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        ids, ordinals, pos = _marks(marks.column("blob").to_pylist())
        order = np.lexsort((ordinals, ids))
        ids, ordinals, pos = ids[order], ordinals[order], pos[order]
        heads = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (ordinals[1:] != ordinals[:-1])]) if len(ids) else []
        found = {(int(ids[a]), int(ordinals[a])): pos[a:b] for a, b in zip(heads, np.r_[heads[1:], len(ids)])} if len(ids) else {}
        out = []
        row_ids = docs.column("doc_id").to_pylist()
        for i, ordinal, text in zip(row_ids, _ordinals(row_ids), column_bytes(docs, "text")):
            words = text.split() if text else []
            starts = found.get((NO_ID if i is None else i, ordinal))
            if starts is None:
                out.append((len(words), 0, [], b" ".join(words) if rejoin else text))
                continue
            covered, spans = intervals(starts, len(words), window)
            kept = b" ".join(compress(words, (~covered).tolist()))
            out.append((len(words), int(covered.sum()), [{"start": int(a), "end": int(b)} for a, b in spans], kept))
        columns = list(zip(*out)) if out else [[]] * 4
        arrays = [pa.array(c, pa.binary()).cast(t) if name == "kept_text" else pa.array(c, t) for c, (name, t) in zip(columns, _FOUND)]
        given = docs.drop_columns(["text", "dest"])
        return pa.table([*given.columns, *arrays], [*given.column_names, *(name for name, _ in _FOUND)])

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = (), rejoin: bool = True) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``n_words, n_removed, intervals, kept_text`` for every row.

    ``intervals`` are the maximal word ranges ``[start, end)`` that went, ``kept_text`` the other
    words joined by one space; without ``rejoin`` a text that loses nothing stays as it is. Other
    columns are ignored, whatever their names.

    Defined cases: a null, empty or short text keeps all its words (``kept_text`` is ``""`` for
    null, or null without ``rejoin``). Windows repeated inside one document, or only among rows
    that share a doc_id, stay. Rows that repeat a doc_id with other texts are judged one by one.
    A null doc_id counts as larger than any other. An empty table gives an empty result.
    """
    # Buckets and groups of documents follow the amount of text, so each fits a task at any size.
    amount = docs.agg(F.sum(F.length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0
    width = max(shuffle_width(docs.sparkSession), -(-amount // BUCKET_CHARS))
    dealt = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            *(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keep)),
            F.col("text").cast("string").alias("text"),
        )
        .withColumn("dest", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2 * width)).cast("int"))
        .repartition(width, "dest")
        .sortWithinPartitions("dest", "doc_id", "text")
    )
    windows = dealt.mapInArrow(_windows(window, width), "bucket int, dest int, blob binary")
    marks = windows.groupBy("bucket").applyInArrow(_bucket, "dest int, blob binary")
    kept = "".join(f"_k{i} {dealt.schema[f'_k{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    removed = _removed(window, rejoin)

    def of_documents(docs: pa.Table, marks: pa.Table) -> pa.Table:
        try:
            return removed(docs, marks)
        finally:
            release()

    shape = f"doc_id long, {kept}n_words long, n_removed long, intervals array<struct<start:long,end:long>>, kept_text string"
    found = dealt.groupBy("dest").cogroup(marks.groupBy("dest")).applyInArrow(of_documents, shape)
    return found.select("doc_id", *(F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)), "n_words", "n_removed", "intervals", "kept_text")

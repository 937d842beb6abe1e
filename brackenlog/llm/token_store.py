"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits. Level ``k`` holds the ``k``-th chunk of every id that has
one, with a bitmap that says which of them continue on the next level. A rank directory over
each bitmap turns a position on one level into one on the next, so any token is read in a few
steps, without decoding a block.

A file is a row of segments in ascending doc_id order, each with the ids of whole documents::

    b"DAC1"  u64 length of the segment  u64 documents  u64 tokens  u64 levels
    per document: u8 has an id, i64 doc_id, u64 tokens          (three arrays)
    per level: u64 entries, chunks (u8), bitmap (u8), ranks (u64 per 512 bits)
    b"\\n"

Segments are written by Spark's text sink with their bytes as the value and the line feed after
it, and read by its binary reader. So the commit protocol covers lost tasks, and any file system
that Spark knows will do. Documents are dealt by ranges of doc_id before they are encoded: one
shuffle of the text. A file is what one such range holds.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from brackenlog.session import shuffle_width

MAGIC = b"DAC1"
BLOCK = 512
SEGMENT_TOKENS = 1 << 19
#: Words without their endings that are kept; a dictionary entry takes some 200 bytes.
MEMO_PARTS = 800_000
END_ID = 2


def pack_levels(ids: np.ndarray) -> bytes:
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        whole = np.r_[bitmap, np.zeros(-len(bitmap) % (BLOCK // 8), np.uint8)].reshape(-1, BLOCK // 8)
        ranks = np.r_[0, np.cumsum(np.bitwise_count(whole).sum(1, dtype=np.uint64))[:-1]].astype(np.uint64) if len(whole) else np.empty(0, np.uint64)
        out.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bitmap.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            return struct.pack("<Q", len(out)) + b"".join(out)


def pack_segment(doc_ids: list, ids: list[bytes]) -> bytes:
    """A segment of documents; ``ids`` holds the ids of each as little-endian 32-bit integers."""
    tokens = np.frombuffer(b"".join(ids), "<u4")
    body = struct.pack("<QQ", len(doc_ids), len(tokens))
    levels = pack_levels(tokens)
    body += levels[:8]
    body += np.array([i is not None for i in doc_ids], np.uint8).tobytes()
    body += np.array([i or 0 for i in doc_ids], "<i8").tobytes()
    body += np.array([len(i) // 4 for i in ids], "<u8").tobytes()
    body += levels[8:]
    return MAGIC + struct.pack("<Q", len(body) + 12) + body


class Segment:
    """One segment of a file, over its bytes."""

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + 4] != MAGIC:
            raise ValueError(f"no segment begins at byte {at}")
        self.length, docs, self.tokens, levels = struct.unpack_from("<QQQQ", data, at + 4)
        at += 36
        real = np.frombuffer(data, np.uint8, docs, at)
        ids = np.frombuffer(data, "<i8", docs, at + docs)
        self.doc_ids = [int(i) if r else None for i, r in zip(ids, real)]
        self.counts = np.frombuffer(data, "<u8", docs, at + 9 * docs)
        at += 17 * docs
        self.levels = []
        for _ in range(levels):
            n = struct.unpack_from("<Q", data, at)[0]
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = -(-n // 8)
            blocks = -(-bits // (BLOCK // 8))
            bitmap = np.frombuffer(data, np.uint8, bits, at + 8 + n)
            ranks = np.frombuffer(data, "<u8", blocks, at + 8 + n + bits)
            self.levels.append((chunks, bitmap, ranks))
            at += 8 + n + bits + 8 * blocks

    def token(self, i: int) -> int:
        """The ``i``-th id of the segment, read on its own."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            inside = bitmap[block * (BLOCK // 8) : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(inside).sum()) + (int(bitmap[i >> 3]) & (1 << (i & 7)) - 1).bit_count()
            shift += 8
        return value

    def all(self) -> np.ndarray:
        """All ids at once, as 32-bit integers."""
        above = None
        for chunks, bitmap, _ in reversed(self.levels):
            ids = chunks.astype("<u4")
            if above is not None:
                ids[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)] |= above << np.uint32(8)
            above = ids
        return above


def segments(data: bytes):
    at = 0
    while at < len(data):
        segment = Segment(data, at)
        yield segment
        at += segment.length + 1  # the sink's line feed


#: ASCII signs; those that end a word are taken off behind an ASCII letter or digit.
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_LETTERS = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
#: Bytes of texts whose words are looked up together.
CHUNK_BYTES = 1 << 23


def _values(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each string of an array begins and ends, and the bytes they are cut from."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
    return offsets, np.frombuffer(words.buffers()[2] or b"", np.uint8)


def _taken(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs laid end to end in ``flat``, those numbered ``which``, end to end; and their lengths."""
    own = lengths[which]
    ends = np.cumsum(own)
    shift = (np.cumsum(lengths) - lengths)[which] - (ends - own)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(shift, own)], own


class Encoder:
    """Ids of texts with a tokenizers file that drops white space, by way of a bounded memo of words.

    White space separates pieces in such a vocabulary, so a text's ids are those of its words. So
    does the place between a letter or digit and the signs that end a word, where a file splits
    letters from signs and folds case; there are far fewer words without them. A word that may
    hold the name of a special token is taken as it stands. The words of some megabytes of text
    are cut and counted as one Arrow array; only different ones are looked up.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.mark = Tokenizer.from_file(path), {}, None
        # Whether the file treats such endings so, and a special token as one id, tried on a few words.
        tried = (("Ab,", ["ab", ","]), ("a9...", ["a9", "..."]), ("x!?", ["x", "!?"]), ("Q'", ["q", "'"]))
        self.plain = all(self._ids([whole])[0] == b"".join(self._ids(parts)) for whole, parts in tried)
        words = ["ab", ",", "\u0301", "Q'9"]
        alone = self._ids(words)
        added = self.tokenizer.get_added_tokens_decoder().items()
        for self.mark in [(t.content, i) for i, t in added if t.special and not (t.normalized or t.single_word)]:
            if self._ids(words) == alone:
                break
        else:
            self.mark = None

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word. As one text, parted by a special token, words cost a third less."""
        if self.mark:
            text, mark = self.mark
            ids = np.array(self.tokenizer.encode_batch_fast([f" {text} ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == mark).tolist()
            # More of them than were put in: a word holds that name itself.
            if len(ends) == len(words) - 1:
                data = ids.tobytes()
                return [data[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)])]
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a string array, in order; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        ends = _values(texts)[0].astype(np.int64)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK_BYTES, "right")) - 1)
            words = pc.ascii_split_whitespace(texts[a:b])
            found = words.flatten().dictionary_encode()
            ids, lengths = _taken(*self._words(found.dictionary), found.indices.to_numpy())
            cuts = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(words.value_lengths().to_numpy())]]
            for c, d in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield ids[c:d].tobytes()
            a = b

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, end to end, and how many each has."""
        if not self.plain:
            return self._parts(words)
        low = pc.ascii_lower(words)
        stem = pc.ascii_rtrim(low, SIGNS)
        ends, data = _values(stem)
        left = np.diff(ends)
        cut = (left > 0) & (left < pc.binary_length(low).to_numpy())
        cut[cut] = _LETTERS[data[ends[1:][cut] - 1]]
        whole = pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        cut &= ~whole
        heads = pc.if_else(pa.array(cut), stem, pc.if_else(pa.array(whole), words, low))
        tails = [w[n:] for w, n in zip(low.filter(pa.array(cut)).cast(pa.binary()).to_pylist(), left[cut].tolist())]
        heads = heads.cast(pa.binary()).dictionary_encode()
        tails = pa.array([b"", *tails], pa.binary()).dictionary_encode()
        flat, lengths = self._parts(pa.concat_arrays([heads.dictionary, tails.dictionary]))
        order = np.zeros((len(words), 2), np.int64)
        order[:, 0] = heads.indices.to_numpy()
        order[:, 1] = len(heads.dictionary)
        order[cut, 1] += tails.indices.to_numpy()[1:]
        ids, lengths = _taken(flat, lengths, order.ravel())
        return ids, lengths.reshape(-1, 2).sum(1)

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts, memo = parts.cast(pa.binary()).to_pylist(), self.memo
        found = list(map(memo.get, parts))
        new = list(dict.fromkeys(p for p, ids in zip(parts, found) if ids is None))
        if len(memo) + len(new) > MEMO_PARTS:
            memo.clear()
            new = list(dict.fromkeys(parts))
        for a in range(0, len(new), 256):
            some = new[a : a + 256]
            memo.update(zip(some, self._ids([p.decode("utf-8", "replace") for p in some])))
        found = [memo[p] if ids is None else ids for p, ids in zip(parts, found)]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encoded(path: str, end_id: int | None):
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        tool, docs, ids, held = encoder(path), [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([pack_segment(docs, ids)], pa.binary())], ["segment"])

        for batch in batches:
            for i, found in zip(batch.column("doc_id").to_pylist(), tool.encode(batch.column("text"))):
                docs.append(i)
                ids.append(found + end)
                held += len(ids[-1]) // 4
                if held >= SEGMENT_TOKENS:
                    yield out()
                    docs, ids, held = [], [], 0
        if docs:
            yield out()

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = END_ID) -> None:
    """Encode every whole text of ``docs`` (``doc_id, text``) into files of ``folder``, by doc_id.

    Defined cases: a null or empty text has only the end id. Null doc_ids come first; rows that
    share a doc_id stay rows of their own, ordered by text. An empty table gives a folder without
    segments. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    found = ordered.mapInArrow(_encoded(tokenizer, end_id), "segment binary")
    found.select(F.col("segment").cast("string").alias("value")).write.option("lineSep", "\n").text(folder)


def _heads(batches):
    for batch in batches:
        totals = [sum(s.tokens for s in segments(data)) for data in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(totals, pa.int64())], ["path", "total"])


_DOCS = pa.schema([("path", pa.string()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _documents(with_ids: bool):
    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                before = 0
                for s in segments(data):
                    ids, ends = s.all(), np.cumsum(s.counts.astype(np.int64))
                    cuts = np.r_[0, ends]
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts, ends)]
                    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))) if with_ids else pa.nulls(len(crc), _DOCS.types[5])
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(crc)), pa.array(s.doc_ids, pa.int64()), pa.array(before + cuts[:-1]), pa.array(s.counts.astype(np.int64)), pa.array(crc, pa.int64()), lists], schema=_DOCS)
                    before += int(ends[-1])

    return run


def read(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of every document in a folder's files.

    ``start`` counts the ids before the document in all files. It adds the place in the file to
    the tokens of the files before, of which there is one row per file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    shape = "path string, doc_id long, inside long, n_tokens long, ids_crc32 long, ids array<int>"
    found = files.mapInArrow(_documents(with_ids), shape)
    part = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.mapInArrow(_heads, "path string, total long").select(part.alias("part"), "total")
    offsets = offsets.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    return found.withColumn("part", part).join(offsets, "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "ids")

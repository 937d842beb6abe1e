"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The search keeps the best path to each position that a piece may still begin at: a window of as
many positions as the longest piece has characters. Whenever the back-pointers of all positions
in the window lead to one boundary, the ids before it are final and are given out, so a text of
any length needs the memory of what is not yet decided.

Where no piece of the vocabulary can cross a boundary, all paths meet for certain. Those places
(before a run of spaces, around characters that stand in no longer piece) are found by one
regular expression; what lies between is searched once and kept in a bounded memo. Segments are
searched in sorted order, so a beginning that several share is searched once.

A piece scores by the logarithm of its rank if the file holds ranks (as for merges), else by
the file's scores. With ranks these are not the ids that merging gives: the cheapest path is
another segmentation, about a seventh longer, and the file's normaliser is not applied, so that
decoding is exact. Scores are whole numbers, so equal sums tie exactly; of equal paths the one
with the longest last piece wins. Text that no piece covers is written in byte pieces, and so
is a literal U+2581, which makes decoding exact.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from brackenlog.llm.tokens import column_bytes, releasing

SPACE = "▁"
SCALE = 1 << 20
MEMO_SEGMENTS = 200_000
LONG_SEGMENT = 64
#: Bytes of texts whose new segments are searched together.
CHUNK = 1 << 20
#: Bytes of ids that make a batch of the result; it is held several times over while it is built.
HELD = 4 << 20


class Vocabulary:
    """Pieces of a model file with their whole-number costs."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = [model.get_score(i) for i in plain]
        ranked = scores == sorted(scores, reverse=True) and all(s == int(s) for s in scores)
        costs = [math.log(2 - s) if ranked else -s for s in scores]
        names = {i: model.id_to_piece(i).replace(SPACE, " ") for i in plain}
        self.pieces = {names[i]: (round(c * SCALE), i) for i, c in zip(plain, costs)}
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        if len(self.bytes) < 256:
            raise ValueError("the vocabulary lacks byte pieces, so not every text has ids")
        # A byte costs more than any piece, so bytes are taken only where nothing else fits.
        self.byte_cost = round((max(costs, default=0) + 10) * SCALE)
        self.longest = max(map(len, self.pieces), default=1)
        # A trie of the pieces: characters lead on, and "" holds the piece that ends here.
        self.trie: dict = {}
        for piece, found in self.pieces.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = found
        self.text = {i: n.encode() for i, n in names.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.split = re.compile(self._boundaries(), re.S)
        self.memo: dict[str, bytes] = {}

    def _boundaries(self) -> str:
        """What lies between places that no piece crosses."""
        long = [p for p in self.pieces if len(p) > 1]
        inside = {c for p in long for c in p}
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in inside and c != " ")
        if any(b == " " != a for p in long for a, b in zip(p, p[1:])):
            return f"[^{alone}]+|[{alone}]" if alone else ".+"
        return f" +[^ {alone}]*|[^ {alone}]+|[{alone}]" if alone else " +[^ ]*|[^ ]+"

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogateescape")]

    def _step(self, cost: list, back: list, open_ends: list, char: str) -> list:
        """Takes in one character: appends the best path to the boundary behind it, and gives the
        begins from which a piece may still grow, with how far it is, older ones first."""
        end = len(cost)
        best, step = None, None
        grown = []
        for begin, node in open_ends:
            node = node.get(char)
            if node is not None:
                grown.append((begin, node))
                found = node.get("")
                if found is not None:
                    total = cost[begin] + found[0]
                    if best is None or total < best:
                        best, step = total, (begin, (found[1],))
        if not grown or grown[-1][0] != end - 1 or "" not in grown[-1][1]:
            # No piece is this character alone, so it may be written in bytes.
            ids = self.fallback(char)
            total = cost[end - 1] + self.byte_cost * len(ids)
            if best is None or total < best:
                best, step = total, (end - 1, tuple(ids))
        cost.append(best)
        back.append(step)
        grown.append((end, self.trie))
        return grown

    def stream(self, chars: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a text given character by character, as soon as they are final."""
        longest = self.longest
        cost, back = [0], [(0, ())]  # best path to each boundary not yet final, and its last step
        open_ends = [(0, self.trie)]
        for char in chars:
            open_ends = self._step(cost, back, open_ends, char)
            if len(cost) > 2 * longest or len(open_ends) == 1:
                meet = self._meeting(back, [b for b, _ in open_ends])
                if meet:
                    yield self._path(back, meet)
                    floor = cost[meet]
                    cost = [c - floor for c in cost[meet:]]
                    back = [(0, ())] + [(b - meet, ids) for b, ids in back[meet + 1 :]]
                    open_ends = [(b - meet, node) for b, node in open_ends]
        if len(back) > 1:
            yield self._path(back, len(back) - 1)

    def search(self, parts: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of parts, each between places where all paths meet.

        Parts are taken in sorted order, and the search goes on from where the last one begins to
        differ. A part longer than ``LONG_SEGMENT`` is streamed by itself.
        """
        before, cost, back, opens = "", [0], [(0, ())], [[(0, self.trie)]]
        for part in sorted(parts):
            if len(part) > LONG_SEGMENT:
                yield part, [i for final in self.stream(part) for i in final]
                continue
            same, most = 0, min(len(before), len(part))
            while same < most and before[same] == part[same]:
                same += 1
            del cost[same + 1 :], back[same + 1 :], opens[same + 1 :]
            for char in part[same:]:
                opens.append(self._step(cost, back, opens[-1], char))
            before = part
            yield part, self._path(back, len(part))

    @staticmethod
    def _meeting(back, ends: list[int]) -> int:
        """The last boundary that the paths to all of ``ends`` share."""
        live = set(ends)
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(back[last][0])
        return live.pop()

    @staticmethod
    def _path(back, end: int) -> list[int]:
        steps = []
        while end > 0:
            end, ids = back[end]
            steps.append(ids)
        return [i for ids in reversed(steps) for i in ids]

    def encode(self, text: bytes) -> bytes:
        """Ids of a text as little-endian 32-bit integers; none for an empty text."""
        return self.checked([text])[0][0]

    def checked(self, texts: list[bytes]) -> list[tuple[bytes, bool]]:
        """Ids of each text, and whether they decode to it byte for byte.

        Parts decode apart from each other, so a distinct one is decoded once, when it is searched.
        """
        wholes = [" " + t.decode("utf-8", "surrogateescape") if t else "" for t in texts]
        parts = [self.split.findall(w) for w in wholes]
        memo = self.memo
        new = {p for own in parts for p in own if p not in memo}
        if len(memo) + len(new) > MEMO_SEGMENTS:
            memo.clear()
            new = {p for own in parts for p in own}
        broken, passing = set(), {}
        for part, ids in self.search(new):
            found = array("i", ids).tobytes()
            if b"".join(map(self.text.__getitem__, ids)) != part.encode("utf-8", "surrogateescape"):
                broken.add(part)
            if len(part) <= LONG_SEGMENT and len(memo) < MEMO_SEGMENTS:
                memo[part] = found
            else:
                passing[part] = found
        out = []
        for whole, own in zip(wholes, parts):
            ids = b"".join([memo[p] if p in memo else passing[p] for p in own]) if passing else b"".join(map(memo.__getitem__, own))
            out.append((ids, sum(map(len, own)) == len(whole) and (not broken or broken.isdisjoint(own))))
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        """The text of ids, without the space that encoding put before it."""
        text = b"".join(map(self.text.__getitem__, ids))
        return text[1:] if text.startswith(b" ") else text


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each worker process, kept from task to task."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` with ``ids, n_tokens, round_trip`` of every whole text; one Arrow pass, no shuffle.

    ``round_trip`` says whether decoding the ids gives the text again, byte for byte.

    Defined cases: a null text has null ids, no tokens and a null ``round_trip``; an empty one
    has an empty list. Repeated rows stay. Other columns are ignored. Empty tables stay empty.
    """
    given = docs.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), F.col("text").cast("string").alias("text"))
    shape = ", ".join([*(f"_k{i} {f.dataType.simpleString()}" for i, f in enumerate(given.schema.fields[:-1])), "ids array<int>, n_tokens long, round_trip boolean"])
    n = len(keys)

    @releasing
    def run(batches):
        tool = vocabulary(path)

        def out(batch, a, b, found, same):
            ends = np.cumsum([len(x or b"") // 4 for x in found])
            ids = np.frombuffer(b"".join(x or b"" for x in found), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids), mask=pa.array([x is None for x in found]))
            counts = pa.array(np.diff(np.r_[0, ends]), pa.int64())
            columns = [batch.column(i).slice(a, b - a) for i in range(n)]
            return pa.RecordBatch.from_arrays([*columns, lists, counts, pa.array(same, pa.bool_())], [*batch.schema.names[:n], "ids", "n_tokens", "round_trip"])

        try:
            for batch in batches:
                sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
                found, same, a, held, at = [], [], 0, 0, 0
                while at < len(sizes):
                    # As many texts at once as make a chunk, at least one; only those are taken out of the batch.
                    end, size = at, 0
                    while end < len(sizes) and (end == at or size + sizes[end] <= CHUNK):
                        size += sizes[end]
                        end += 1
                    texts = column_bytes(batch.slice(at, end - at), "text")
                    got = iter(tool.checked([t for t in texts if t is not None]))
                    for t in texts:
                        ids, good = (None, None) if t is None else next(got)
                        found.append(ids)
                        same.append(good)
                        held += len(ids or b"")
                    at = end
                    if held > HELD:
                        yield out(batch, a, at, found, same)
                        found, same, a, held = [], [], at, 0
                if found:
                    yield out(batch, a, batch.num_rows, found, same)
        finally:
            # The worker serves other stages too; what it has searched would stay in it.
            tool.memo.clear()

    encoded = given.mapInArrow(run, shape)
    return encoded.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), "ids", "n_tokens", "round_trip")


def decode(encoded: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` with the ``text`` of ``ids``; null for null ids."""
    given = encoded.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), "ids")
    shape = ", ".join([*(f"_k{i} {f.dataType.simpleString()}" for i, f in enumerate(given.schema.fields[:-1])), "text binary"])

    def run(batches):
        tool = vocabulary(path)
        for batch in batches:
            texts = [None if ids is None else tool.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], [*batch.schema.names[:-1], "text"])

    return given.mapInArrow(run, shape).select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), F.col("text").cast("string").alias("text"))

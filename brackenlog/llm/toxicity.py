"""Toxicity of texts that may hide their words: noisy-channel deobfuscation, then a linear score.

1. **Language model.** Letter trigrams of all texts, counted in Spark. Letters fall into 63 classes
   (a to z, and 37 for all others) and a boundary, so the counts are 64**3 numbers however large
   the corpus is, and every text counts.
2. **Deobfuscation.** Runs that may hide a word (digits or signs among letters, letters standing
   one by one, a letter three times over) become a lattice of readings for each character: itself,
   a letter it stands for, a repetition, noise, or a boundary. Viterbi over states of two letters
   takes the cheapest reading under channel costs and the language model. Where all survivors
   agree on the last two letters the path so far is committed, so memory does not grow with the
   run. Everything else in the text stays as it is.
3. **Score.** Logistic regression on letter 3-, 4- and 5-grams of the restored text. Those that
   tell the classes apart are chosen by the log-likelihood ratio of their document counts.

The classifier is fitted on at most ``SAMPLE`` labelled documents of each class, chosen by a hash
of their id, equal texts once; class sizes weigh the rows back. Their ids are the only broadcast.
Language-model counts and scores cover every text whole.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brackenlog.llm.components import stored

#: Signs and the letters they stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "!": "i", "|": "il", "+": "t", "(": "c", "£": "l"}
#: These are punctuation too and stand for a letter only before one.
ONLY_BEFORE = "!|+("
SEPARATORS = " \t\n\r.-_*,/~·"
#: Costs of readings, in nats: a letter for a sign, an unmarked for a marked letter, a sign as
#: noise or as boundary, punctuation or a separator as nothing, a space or another separator as
#: boundary, a letter written twice for one, and each further time.
SIGN, MARK, NOISE, BREAK, JOIN = 1.5, 3.0, 12.0, 9.0, 0.5
SPACE, SEPARATOR, TWICE, MORE = 1.0, 2.0, 5.0, 0.5
#: Letters that stand one by one make a run from this many on.
SINGLES = 4
SYMBOLS = 64
#: Weight of the shorter context in the language model.
BACKOFF = 4.0
#: Characters handled at once (a longer text is handled alone), and readings kept in the memo.
CHUNK, MEMO = 500_000, 50_000

SAMPLE = 20_000
BUCKETS = 1 << 22
#: N-grams in the classifier at most, their least log-likelihood ratio, and the pull to zero.
FEATURES, LEAST_RATIO, RIDGE = 2048, 12.0, 0.004
STEPS = 400


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its symbol (0 for what is no letter) and its kind: 1 letter, 2 sign,
    3 sign only before a letter, 4 separator."""
    symbol, kind = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    symbol[letters] = 27 + letters % 37
    for k in range(26):
        symbol[[65 + k, 97 + k]] = 1 + k
    kind[letters] = 1
    for c in SEPARATORS:
        kind[ord(c)] = 4
    for c in STANDS_FOR:
        kind[ord(c)] = 3 if c in ONLY_BEFORE else 2
    return symbol, kind


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _symbols(points: np.ndarray) -> np.ndarray:
    """Symbols of a text, each run of what is no letter one boundary, with one at either end."""
    s = _tables()[0][points]
    s = np.concatenate([[0], s, [0]]).astype(np.int64)
    return s[(s != 0) | np.r_[True, s[:-1] != 0]]


def _chunks(texts: list[str]):
    """Texts joined by line ends to chunks, with the number of the first text of each."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size > CHUNK or i == len(texts) - 1:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


def _texts(batch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def trigrams(text: str) -> np.ndarray:
    """Numbers of the trigrams of a text; a word begins after two boundaries."""
    s = _symbols(_points(text))
    s = np.repeat(s, np.where(s == 0, 2, 1))
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def language_model(docs: DataFrame) -> np.ndarray:
    """Cost of each trigram, (64, 64, 64), from the counts over all texts."""

    def count(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, texts in _chunks(_texts(batch, "text")):
                total += np.bincount(trigrams("\n".join(texts)), minlength=SYMBOLS**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["g", "n"])

    # At most 64**3 rows come to the driver.
    found = docs.select("text").where("text <> ''").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**3)
    counts[found.column("g").to_numpy()] = found.column("n").to_numpy()
    return model_costs(counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS))


def model_costs(n: np.ndarray) -> np.ndarray:
    """Costs of trigrams from their counts, each context backing off to the shorter one."""
    # What follows two boundaries after a word is no choice of the writer.
    n = n.copy()
    n[1:, 0, 0] = 0
    one = n.sum((0, 1)) + 1.0
    one /= one.sum()
    two = n.sum(0)
    two = (two + BACKOFF * one) / (two.sum(1, keepdims=True) + BACKOFF)
    three = (n + BACKOFF * two) / (n.sum(2, keepdims=True) + BACKOFF)
    return -np.log(three).astype(np.float32)


def readings(c: str, repeated: int) -> list[tuple[str, float]]:
    """What a character, the same as ``repeated`` before it, may stand for, with costs; '' is
    nothing and ' ' a boundary."""
    if c.isalpha():
        out = [(c, 0.0)]
        plain = unicodedata.normalize("NFD", c)[0]
        if plain != c and plain.isalpha():
            out.append((plain, MARK))
    elif c in ONLY_BEFORE:
        out = [(x, SIGN) for x in STANDS_FOR[c]] + [("", JOIN), (" ", SEPARATOR)]
    elif c in STANDS_FOR:
        out = [(x, SIGN) for x in STANDS_FOR[c]] + [("", NOISE), (" ", BREAK)]
    else:
        return [(" ", SPACE if c.isspace() else SEPARATOR), ("", JOIN)]
    if repeated:
        out.append(("", TWICE if repeated == 1 else MORE))
    return out


def decode(run: str, costs: np.ndarray) -> str:
    """The cheapest reading of a run of lower-case characters."""
    symbol = _tables()[0]
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    done: list[str] = []
    before, repeated = None, 0

    def written(path):
        out = []
        while path is not None:
            path, c = path
            out.append(c)
        return out[::-1]

    for c in run:
        after: dict = {}
        before, repeated = c, repeated + 1 if c == before else 0
        for x, price in readings(c, repeated):
            z = int(symbol[ord(x)]) if x else -1
            for (a, b), (cost, path) in states.items():
                if z < 0:
                    key, total = (a, b), cost + price
                elif z == 0:
                    key, total = (0, 0), cost + price + (float(costs[a, b, 0]) if b else 0.0)
                else:
                    key, total = (b, z), cost + price + float(costs[a, b, z])
                if key not in after or total < after[key][0]:
                    after[key] = (total, path if z < 0 or (z == 0 and not b) else (path, " " if z == 0 else x))
        states = after
        if len(states) == 1:
            ((key, (cost, path)),) = states.items()
            done += written(path)
            states = {key: (0.0, None)}
    end = min(states.items(), key=lambda s: s[1][0] + (float(costs[*s[0], 0]) if s[0][1] else 0.0))
    return "".join(done + written(end[1][1])).strip()


def suspects(text: str) -> list[tuple[int, int]]:
    """Where runs that may hide a word begin and end, in order and apart."""
    points = _points(text)
    n = len(points)
    if n < 2:
        return []
    kind = np.concatenate([[4], _tables()[1][points], [4]])
    own, left, right = kind[1:-1], kind[:-2], kind[2:]
    letter = own == 1
    solid = (right == 1) | (right == 2)
    marks = ((own == 2) & ((left == 1) | (right == 1))) | ((own == 3) & solid)
    # A sign beside nothing but digits is a number.
    low = points | 32
    same = letter[1:] & letter[:-1] & (low[1:] == low[:-1])
    marks[2:] |= same[1:] & same[:-1]
    found = []
    at = np.flatnonzero(marks)
    if len(at):
        spaces = np.flatnonzero((points == 32) | ((points >= 9) & (points <= 13)))
        k = np.searchsorted(spaces, at)
        begin = np.r_[-1, spaces][k] + 1
        end = np.r_[spaces, n][k]
        found += list(dict.fromkeys(zip(begin.tolist(), end.tolist())))
    single = (letter | (own == 2) | (own == 3)) & (left == 4) & (right == 4)
    if single.any():
        chain = np.concatenate([single, [False] * (2 * SINGLES)])
        first = chain[:n].copy()
        for k in range(1, SINGLES):
            first &= chain[2 * k : 2 * k + n]
        last = -1
        for i in np.flatnonzero(first).tolist():
            if i <= last:
                continue
            last = i
            while last + 2 < n and chain[last + 2]:
                last += 2
            if letter[i : last + 1].sum() >= 2:
                found.append((i, last + 1))
    found.sort()
    apart: list[tuple[int, int]] = []
    for a, b in found:
        if apart and a < apart[-1][1]:
            apart[-1] = (apart[-1][0], max(b, apart[-1][1]))
        else:
            apart.append((a, b))
    return apart


class Restorer:
    """Restores texts, with a memo of the runs met."""

    def __init__(self, costs: np.ndarray):
        self.costs, self.memo = costs, {}

    def _read(self, run: str) -> str:
        run = run.lower()
        found = self.memo.get(run)
        if found is None:
            found = decode(run, self.costs)
            if len(run) <= 64:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[run] = found
        return found

    def __call__(self, text: str) -> str:
        out, at = [], 0
        for a, b in suspects(text):
            out += [text[at:a], self._read(text[a:b])]
            at = b
        return "".join([*out, text[at:]]) if at else text


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts and buckets of their letter n-grams, within words and their ends."""
    joined = "\n".join(texts)
    s = _tables()[0][_points(joined)].astype(np.int64)
    of = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) + 1 for t in texts])[: len(s)]
    s, of = np.r_[0, s, 0], np.r_[0, of, len(texts) - 1]
    keep = (s != 0) | np.r_[True, s[:-1] != 0]
    s, of = s[keep], of[keep]
    owners, buckets = [], []
    inner = np.r_[0, np.cumsum(s == 0)]
    for size in (3, 4, 5):
        count = len(s) - size + 1
        if count <= 0:
            continue
        code = np.full(count, size, np.uint64)
        for k in range(size):
            code = code * np.uint64(SYMBOLS) + s[k : k + count].astype(np.uint64)
        # No boundary but at the ends, so the n-gram belongs to one word.
        whole = inner[size - 1 : size - 1 + count] == inner[1 : 1 + count]
        code = (code[whole] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 22)
        buckets.append(code.astype(np.int64))
        owners.append(of[1 : 1 + count][whole])
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(owners), np.concatenate(buckets)


@dataclass(frozen=True)
class Toxicity:
    """Chosen buckets with their weights, and the intercept; ``costs`` restores the texts."""

    costs: np.ndarray
    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def _hits(texts: list[str], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a text's number and a chosen n-gram in it."""
    owners, buckets = ngrams(texts)
    at = place[buckets]
    some = at >= 0
    pairs = np.unique(owners[some] * FEATURES + at[some])
    return pairs // FEATURES, pairs % FEATURES


def _places(buckets: np.ndarray) -> np.ndarray:
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    return place


def _sampled(docs: DataFrame, labels: DataFrame, costs: np.ndarray) -> tuple[DataFrame, dict[int, int]]:
    """Restored texts and labels of the sample, each text once, and the rows of each class."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for label in sorted(sizes):
        own = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        chosen = own if chosen is None else chosen.unionByName(own)
    if chosen is None:
        return None, sizes
    # At most SAMPLE ids of each class are broadcast.
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")

    def restore(batches):
        again = Restorer(costs)
        for batch in batches:
            texts = [again(t) for t in _texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("toxic")], ["text", "toxic"])

    restored = rows.select("text", "toxic").mapInArrow(restore, "text string, toxic int")
    once = restored.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.first("text").alias("text"))
    return stored(once, "toxicity-sample"), sizes


def _ratio(k1, n1, k0, n0):
    """Log-likelihood ratio of two document counts, signed by the class that has more."""

    def part(k, n, p):
        return F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)

    both = (k1 + k0) / (n1 + n0)
    rest = F.greatest(1 - both, F.lit(1e-12))
    found = part(k1, n1, both) + part(k0, n0, both) + part(n1 - k1, n1, rest) + part(n0 - k0, n0, rest)
    return 2 * found * F.when(k1 * n0 >= k0 * n1, 1).otherwise(-1)


def fit_weights(rows: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Logistic regression over (row, feature) pairs, by gradient steps with momentum of both orders."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    weight = weight / weight.sum()
    w[-1] = np.log((weight @ y + 1e-6) / (weight @ (1 - y) + 1e-6))
    ridge = np.full(width + 1, RIDGE / np.sqrt(len(y) + 1))
    ridge[-1] = 0
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, w[at], len(y)) + w[-1]
        off = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.r_[np.bincount(at, off[rows], width), off.sum()] + ridge * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, costs: np.ndarray) -> Toxicity:
    """A classifier from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``).

    Where a document has several labels the highest holds. Without rows of both classes there is
    nothing to tell apart, and every text gets the share of toxic rows (0 without any).
    """
    sample, sizes = _sampled(docs, labels, costs)
    none = np.empty(0, np.int64)
    got = {} if sample is None else {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(got) < 2:
        share = 0.0 if not got else float(max(got))
        return Toxicity(costs, none, np.empty(0), 12.0 if share else -12.0)

    def count(batches):
        total = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            toxic = np.array(batch.column("toxic").to_pylist())
            for first, texts in _chunks(_texts(batch, "text")):
                owners, buckets = ngrams(texts)
                pairs = np.unique(owners * BUCKETS + buckets)
                for c in (0, 1):
                    mine = toxic[first + pairs // BUCKETS] == c
                    total[c] += np.bincount(pairs[mine] % BUCKETS, minlength=BUCKETS).astype(np.int32)
        some = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some].astype(np.int64)), pa.array(total[1, some].astype(np.int64))], ["bucket", "k0", "k1"])

    counts = sample.mapInArrow(count, "bucket long, k0 long, k1 long").groupBy("bucket").agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1"))
    ratio = _ratio(F.col("k1"), F.lit(got[1]), F.col("k0"), F.lit(got[0]))
    chosen = counts.withColumn("ratio", ratio).where(F.abs("ratio") >= LEAST_RATIO).orderBy(F.abs("ratio").desc(), "bucket").limit(FEATURES)
    buckets = np.array([r["bucket"] for r in chosen.collect()], np.int64)

    def seen(batches):
        place = _places(buckets)
        for batch in batches:
            texts = _texts(batch, "text")
            held: list[list[int]] = [[] for _ in texts]
            for first, some in _chunks(texts):
                for i, at in zip(*(x.tolist() for x in _hits(some, place))):
                    held[first + i].append(at)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(held, pa.list_(pa.int32()))], ["toxic", "hits"])

    # A few hundred bytes for each of at most 2 * SAMPLE rows.
    table = sample.mapInArrow(seen, "toxic int, hits array<int>").orderBy("toxic", "hits").toArrow()
    y = table.column("toxic").to_numpy().astype(float)
    held = table.column("hits").combine_chunks()
    rows = np.repeat(np.arange(len(y)), np.diff(held.offsets.to_numpy()))
    at = held.flatten().to_numpy()
    weight = np.where(y == 1, sizes[1] / got[1], sizes[0] / got[0])
    weights, bias = fit_weights(rows, at, y, weight, len(buckets))
    return Toxicity(costs, buckets, weights, bias)


def predict(docs: DataFrame, model: Toxicity) -> DataFrame:
    """``docs`` with ``restored``, ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.5 on).

    Defined cases: a null text is restored as null and scored as an empty one, which gets the
    score of a text without any known n-gram. Repeated rows are rows. Columns of these three
    names that ``docs`` has already are replaced, all others stay. Empty tables give empty results.
    """
    added = ("restored", "score", "predicted")
    own = [c for c in docs.columns if c not in added]
    given = docs.select(*(F.col(f"`{c}`") for c in own))
    columns = [*own, *added]
    schema = given.withColumns({"restored": F.lit(None).cast("string"), "score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def run(batches):
        place, again = _places(model.buckets), Restorer(model.costs)
        for batch in batches:
            raw = batch.column("text").to_pylist()
            restored = [None if t is None else again(t) for t in raw]
            z = np.full(len(raw), model.bias)
            for first, texts in _chunks([t or "" for t in restored]):
                owners, at = _hits(texts, place)
                z[first : first + len(texts)] += np.bincount(owners, model.weights[at], len(texts))
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            kept = [batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(restored, pa.string()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], columns)

    return given.mapInArrow(run, schema)


def held_out(doc_id: str):
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))

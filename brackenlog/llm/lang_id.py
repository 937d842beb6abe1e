"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read a text's bytes forwards and backwards, a softmax labels every byte position from
both states, and a document's probabilities are the mean over all its positions. The network
is trained in numpy by backpropagation through time on a bounded sample of labelled rows.

Long texts are cut into segments of ``SEGMENT`` bytes that are all read; each starts from the
zero state, so a document of any length needs the memory of one batch of segments. Scoring is
one Arrow pass over the table without a shuffle; the model is a few dozen kilobytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brackenlog.llm.tokens import column_bytes, releasing

HIDDEN, SEGMENT, GROUP = 8, 128, 4096
PAD = 256
#: Bounds of the training sample: rows for each language, windows of a row, bytes of a window.
ROWS_PER_LANGUAGE, WINDOWS, WINDOW = 400, 3, 64
STEPS, BATCH, RATE = 360, 96, 0.01
UNKNOWN = "und"


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * a) + 0.5


@dataclass
class Network:
    """Weights of both directions; tables hold the input side of each gate, by byte."""

    labels: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, labels: list[str], seed: int = 7) -> Network:
        rng, w = np.random.default_rng(seed), {}
        for d in "fb":
            for gate in "zrn":
                w[f"x{gate}{d}"] = rng.normal(0, 0.3, (257, HIDDEN))
                w[f"h{gate}{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, HIDDEN))
            w[f"o{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, len(labels)))
        w["bias"] = np.zeros(len(labels))
        net = cls(labels, {k: v.astype(np.float32) for k, v in w.items()})
        net.hold_padding()
        return net

    def hold_padding(self) -> None:
        """Padding drives the update gate to 1, so the state passes through unchanged."""
        for d in "fb":
            self.weights[f"xz{d}"][PAD] = 40
            self.weights[f"xr{d}"][PAD] = 0
            self.weights[f"xn{d}"][PAD] = 0

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Scores of every position: ``x`` is (time, rows) of bytes, the result (time, rows, labels)."""
        w, (steps, rows) = self.weights, x.shape
        out = np.empty((steps, rows, len(self.labels)), np.float32)
        out[:] = w["bias"]
        half = np.float32(0.5)
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            xz, xr, xn = w[f"xz{d}"] * half, w[f"xr{d}"] * half, w[f"xn{d}"]
            hz, hr, hn, o = w[f"hz{d}"] * half, w[f"hr{d}"] * half, w[f"hn{d}"], w[f"o{d}"]
            h, z, r, n, g = (np.zeros((rows, HIDDEN), np.float32) for _ in range(5))
            for t in order:
                at = x[t]
                for gate, table, square in ((z, xz, hz), (r, xr, hr)):
                    np.take(table, at, 0, gate, "clip")
                    np.matmul(h, square, g)
                    gate += g
                    np.tanh(gate, gate)
                    gate *= half
                    gate += half
                np.matmul(h, hn, g)
                g *= r
                np.take(xn, at, 0, n, "clip")
                n += g
                np.tanh(n, n)
                h -= n
                h *= z
                h += n
                out[t] += h @ o
        return out

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions that are not padding, and its gradient through time."""
        w, (steps, rows) = self.weights, x.shape
        states = {}
        logits = np.empty((steps, rows, len(self.labels)), np.float32)
        logits[:] = w["bias"]
        orders = {"f": range(steps), "b": range(steps - 1, -1, -1)}
        for d, order in orders.items():
            h = np.zeros((rows, HIDDEN), np.float32)
            for t in order:
                z = _sigmoid(w[f"xz{d}"][x[t]] + h @ w[f"hz{d}"])
                r = _sigmoid(w[f"xr{d}"][x[t]] + h @ w[f"hr{d}"])
                g = h @ w[f"hn{d}"]
                n = np.tanh(w[f"xn{d}"][x[t]] + r * g)
                new = n + z * (h - n)
                states[d, t] = h, z, r, g, n, new
                h = new
                logits[t] += h @ w[f"o{d}"]
        p = np.exp(logits - logits.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        real = (x != PAD).astype(np.float32)
        total = real.sum()
        picked = np.take_along_axis(p, np.broadcast_to(y, (steps, rows))[..., None], 2)[..., 0]
        loss = float(-(np.log(picked + 1e-9) * real).sum() / total)
        p[:, np.arange(rows), y] -= 1
        p *= (real / total)[..., None]
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["bias"] = p.sum((0, 1))
        for d, order in orders.items():
            later = np.zeros((rows, HIDDEN), np.float32)
            parts = {gate: np.empty((steps, rows, HIDDEN), np.float32) for gate in "zrn"}
            for t in reversed(order):
                h, z, r, g, n, new = states[d, t]
                grad[f"o{d}"] += new.T @ p[t]
                dh = later + p[t] @ w[f"o{d}"].T
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * g * r * (1 - r)
                dg = dn * r
                later = dh * z + dz @ w[f"hz{d}"].T + dr @ w[f"hr{d}"].T + dg @ w[f"hn{d}"].T
                for gate, a in (("z", dz), ("r", dr), ("n", dg)):
                    grad[f"h{gate}{d}"] += h.T @ a
                for gate, a in (("z", dz), ("r", dr), ("n", dn)):
                    parts[gate][t] = a
            for gate, a in parts.items():
                np.add.at(grad[f"x{gate}{d}"], x.ravel(), a.reshape(-1, HIDDEN))
        return loss, grad

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 7) -> float:
        """Adam with a falling rate on windows ``x`` (rows, bytes) of labels ``y``; the last loss."""
        rng, loss = np.random.default_rng(seed), 0.0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        members = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        members = [m for m in members if len(m)]
        for step in range(1, steps + 1):
            # Each language has the same share of a batch, so that rare ones are learned too.
            rows = np.concatenate([rng.choice(m, -(-batch // len(members))) for m in members])
            loss, grad = self.loss_and_gradient(np.ascontiguousarray(x[rows].T), y[rows])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = RATE * (1 - 0.9 * step / steps)
            for k, g in grad.items():
                g *= min(1.0, 1.0 / (norm + 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                self.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            self.hold_padding()
        return loss

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all bytes of each text, (texts, labels); zeros for empty ones."""
        sums = np.zeros((len(texts), len(self.labels)))
        for owners, x in _segments(texts):
            p = [np.ascontiguousarray(a) for a in np.moveaxis(self.logits(x), 2, 0)]
            top = np.maximum.reduce(p)
            for a in p:
                a -= top
                np.exp(a, a)
            share = (x != PAD) / np.add.reduce(p)
            np.add.at(sums, owners, np.stack([(a * share).sum(0) for a in p], 1))
        return sums / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def _padded(texts: list[bytes], width: int) -> np.ndarray:
    out = np.full((len(texts), width), PAD, np.intp)
    for row, t in zip(out, texts):
        row[: len(t)] = np.frombuffer(t, np.uint8)
    return out


def _segments(texts: list[bytes]):
    """Whole texts in segments: groups of owners and (time, rows) byte matrices.

    Full segments are grouped apart from the rests, and rests by length, so little is padding.
    """
    owners, parts, rests = [], [], []
    for i, t in enumerate(texts):
        full = len(t) - len(t) % SEGMENT
        for a in range(0, full, SEGMENT):
            owners.append(i)
            parts.append(t[a : a + SEGMENT])
            if len(parts) == GROUP:
                yield np.array(owners), np.frombuffer(b"".join(parts), np.uint8).reshape(GROUP, SEGMENT).T.astype(np.intp, order="C")
                owners, parts = [], []
        if len(t) > full:
            rests.append((len(t) - full, i))
    if parts:
        yield np.array(owners), np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), SEGMENT).T.astype(np.intp, order="C")
    rests.sort()
    for a in range(0, len(rests), GROUP // 4):
        group = rests[a : a + GROUP // 4]
        yield np.array([i for _, i in group]), np.ascontiguousarray(_padded([texts[i][-n:] for n, i in group], group[-1][0]).T)


def sample(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Windows of at most ``ROWS_PER_LANGUAGE`` rows for each language, chosen by a hash of the text.

    The different texts of each language are counted first and come by a threshold on the hash, so
    copies crowd nothing out, a language with few texts gives all of them, no language's rows meet
    in one task and the driver receives a few hundred bytes for each chosen row. The
    list of languages is the domain of a label, some hundreds at most.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    texts = rows.select("lang", "h").distinct()
    counts = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(counts)
    if not labels:
        return [], np.empty((0, WINDOW), np.int16), np.empty(0, np.int64)
    chosen = F.lit(False)
    for lang in labels:
        share = min(1.0, ROWS_PER_LANGUAGE / counts[lang])
        chosen = F.when(F.col("lang") == lang, F.col("h") < F.lit(int(share * (1 << 40)))).otherwise(chosen)
    room = F.greatest(F.lit(1), F.length("text") - F.lit(WINDOW))
    cuts = [F.substring("text", F.pmod(F.xxhash64(F.lit(k), "h"), room) + 1, F.lit(WINDOW)) for k in range(WINDOWS)]
    found = rows.where(chosen).select("lang", "h", F.explode(F.array(*cuts)).alias("cut")).distinct().orderBy("h", "lang", "cut").collect()
    x = _padded([r["cut"].encode()[:WINDOW] for r in found], WINDOW)
    return labels, x, np.array([labels.index(r["lang"]) for r in found])


def train(labelled: DataFrame) -> Network:
    """A network for the languages of ``labelled`` (``text, lang``); rows lacking either are skipped."""
    labels, x, y = sample(labelled)
    net = Network.fresh(labels)
    if labels:
        net.train(x, y)
    return net


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the whole text and nothing else.

    Defined cases: ``und`` with score 0 if the text is null or holds no letter, or if nothing
    was learned. Ties go to the first label in code-point order. Columns of these names that
    ``docs`` has already are replaced, all others stay. Empty tables give empty results.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "text")]
    given = docs.select(
        *(F.col(f"`{c}`") for c in keep),
        *([F.col("text")] if "text" in docs.columns else []),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letters"),
    )
    out = given.select(*[f"`{c}`" for c in given.columns if c != "__letters"], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"))

    columns = out.columns

    @releasing
    def run(batches):
        for batch in batches:
            texts = column_bytes(batch, "text")
            use = [i for i, ok in enumerate(batch.column("__letters").to_pylist()) if ok and net.labels]
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if use:
                p = net.pooled([texts[i] for i in use])
                best = p.argmax(1)
                for row, i in enumerate(use):
                    names[i], scores[i] = net.labels[best[row]], min(1.0, float(p[row, best[row]]))
            kept = [batch.column(c) for c in columns[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names), pa.array(scores, pa.float64())], columns)

    return given.mapInArrow(run, out.schema)


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))

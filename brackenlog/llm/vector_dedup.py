"""Near-duplicate vectors by a pivot-permutation index.

Reference vectors, a bounded sample, describe every vector by its nearest ones in order. The index
is the inverted list of each pivot within a label. Two vectors are compared if they share at least
``SHARED`` of their nearest pivots; such a pair is met in the list of every shared pivot and counts
in that of the lowest only. Candidates are verified by cosine in double precision.

* Pivots are spread: none is within ``SPREAD`` of another, so a dense group, however many rows it
  holds, cannot fill the sample with its own kind, among which the order of the nearest is noise.
* The number of nearest pivots grows with that of the pivots (``nearest_of``), so that the pivots
  two close vectors share do not get fewer with the size of the table.
* Each length of vectors has an index of its own; one of up to ``TILE`` rows is a single list,
  whose pairs are all compared.

* Equal vectors of one label are one node with a weight, so copies cost nothing more.
* Lists are cut into tiles of at most ``TILE`` rows, and a task compares two tiles by matrix
  products. It gives a count per vector and the links of a spanning forest of what it found,
  never all pairs, so its output is linear in its rows whatever the list holds.
* The number of pivots grows with the vectors, so lists keep their length on spread data. The
  lengths of vectors are taken to be few: each has its pivots in every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brackenlog.llm.components import components, stored

COSINE = 0.93
SHARED = 2
#: Vectors for each pivot, and the least and most pivots. The most bounds the sample.
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 400, 32, 1024
#: Vectors looked at for each pivot, and the cosine that pivots do not reach between them.
TRIED, SPREAD = 8, 0.6
TILE = 2048


def nearest_of(pivots: int) -> int:
    """How many nearest pivots describe a vector: 8 of 32, 13 of 256, 18 of 1024."""
    return min(pivots, 8 + 2 * max(0, (pivots // 32).bit_length() - 1))


def spread(candidates: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` unit vectors out of ``candidates``, in their order, none close to another."""
    unit = candidates / np.linalg.norm(candidates, axis=1, keepdims=True)
    free, chosen = np.ones(len(unit), bool), []
    for i in range(len(unit)):
        if free[i]:
            chosen.append(i)
            if len(chosen) == count:
                break
            free &= unit @ unit[i] < SPREAD
    return unit[chosen]


def _nearest(pivots: dict[int, np.ndarray]):
    """Ordered nearest pivots of each vector, by cosine; the list 0 where a length has none."""

    def run(batches):
        for batch in batches:
            rows = batch.column("vector").to_pylist()
            sizes = np.array([len(r) for r in rows])
            found = [[0]] * len(rows)
            for size, unit in pivots.items():
                own, k = np.flatnonzero(sizes == size), nearest_of(len(unit))
                for a in range(0, len(own), 4096):
                    some = own[a : a + 4096].tolist()
                    v = np.array([rows[i] for i in some])
                    v /= np.linalg.norm(v, axis=1, keepdims=True)
                    near = np.argsort(-(v @ unit.T), 1, kind="stable")[:, :k].astype(np.int32).tolist()
                    for i, own_near in zip(some, near):
                        found[i] = own_near
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), batch.column("weight"), batch.column("vector"), pa.array(found, pa.list_(pa.int32()))], ["node", "label", "weight", "vector", "nearest"])

    return run


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Which of the links make a spanning forest of ``n`` rows."""
    above, keep = list(range(n)), np.zeros(len(i), bool)

    def root(x):
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = root(a), root(b)
        if a != b:
            above[max(a, b)] = min(a, b)
            keep[k] = True
    return keep


def _tile(threshold: float):
    schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("count", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, side, weight = (table.column(c).to_numpy() for c in ("node", "side", "weight"))
        pivot, one, two = (table.column(c)[0].as_py() for c in ("pivot", "one", "two"))
        nearest = np.array(table.column("nearest").to_pylist(), np.int64)
        v = np.array(table.column("vector").to_pylist(), np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        member = np.zeros((len(node), int(nearest.max()) + 1), np.float32)
        np.put_along_axis(member, nearest, 1, 1)
        lower = member[:, :pivot]
        # A tile against itself has its rows once, as side 1.
        left, right = np.flatnonzero(side == one), np.flatnonzero(side == two)
        found_i, found_j = [], []
        for a in range(0, len(left), 256):
            rows = left[a : a + 256]
            shared = (member[rows] @ member[right].T >= min(SHARED, nearest.shape[1])) & (lower[rows] @ lower[right].T == 0)
            if one == two:
                shared &= rows[:, None] < right[None, :]
            shared &= v[rows] @ v[right].T >= threshold
            i, j = np.nonzero(shared)
            found_i.append(rows[i])
            found_j.append(right[j])
        i = np.concatenate(found_i) if found_i else np.empty(0, np.int64)
        j = np.concatenate(found_j) if found_j else np.empty(0, np.int64)
        counts = np.bincount(i, weight[j], len(node)) + np.bincount(j, weight[i], len(node))
        some = np.flatnonzero(counts)
        keep = _forest(i, j, len(node))
        links = keep.sum()
        return pa.table(
            {
                "node": np.r_[node[some], node[i[keep]]],
                "other": pa.array(np.r_[np.zeros(len(some), np.int64), node[j[keep]]], mask=np.r_[np.ones(len(some), bool), np.zeros(links, bool)]),
                "count": np.r_[counts[some].astype(np.int64), np.zeros(links, np.int64)],
            },
            schema=schema,
        )

    return run


def usable(vector) -> F.Column:
    """Whether a vector can have links: no null, no component that is null or not finite, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = COSINE, tile: int = TILE, per_pivot: int = PER_PIVOT, most_pivots: int = MOST_PIVOTS
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding, label``).

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest vec_id
    reachable by links, itself included.

    Defined cases: vectors that are null, zero, or hold null or non-finite components, rows with a
    null label or vec_id link with nothing, and vectors of different lengths not with each other;
    with a null vec_id ``component_id`` is null and the row is kept. Rows that repeat a vec_id
    count as rows, but are one node. Other columns are ignored. An empty table gives an empty
    result.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"))
    fit = given.where(usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = stored(fit.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight")), "vector-classes")
    sizes = classes.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()
    if not sizes:
        return given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # At most TRIED * MOST_PIVOTS rows of a length come to the driver, chosen by a hash.
    pivots = {}
    for r in sizes:
        if r["n"] > tile:
            count = min(most_pivots, max(LEAST_PIVOTS, r["n"] // per_pivot))
            tried = classes.where(F.size("vector") == r["size"]).select("vector", F.xxhash64("vector").alias("h")).orderBy("h", "vector").limit(TRIED * count)
            pivots[r["size"]] = spread(np.array([x["vector"] for x in tried.collect()]), count)
    described = classes.mapInArrow(_nearest(pivots), "node long, label string, weight long, vector array<double>, nearest array<int>")
    index = stored(described, "pivot-index")
    lists = index.select("*", F.size("vector").alias("size"), F.explode("nearest").alias("pivot"))
    lengths = index.select("label", F.size("vector").alias("size"), F.explode("nearest").alias("pivot")).groupBy("label", "size", "pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).alias("tiles"))
    placed = lists.join(lengths, ["label", "size", "pivot"]).withColumn("side", F.pmod(F.xxhash64("node", "pivot"), F.col("tiles")))
    # A row of tile s takes part in the pairs (s, t) for t >= s and (t, s) for t < s.
    sent = placed.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumn("one", F.least("side", "t")).withColumn("two", F.greatest("side", "t"))
    met = stored(sent.select("label", "size", "pivot", "one", "two", "side", "node", "weight", "vector", "nearest").groupBy("label", "size", "pivot", "one", "two").applyInArrow(_tile(threshold), "node long, other long, count long"), "vector-links")
    counts = met.where("other IS NULL").groupBy("node").agg(F.sum("count").alias("links"))
    labels = components(met.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "n")
    named = classes.join(counts, "node", "left").join(labels, F.col("node") == F.col("n"), "left")
    named = named.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    # Only rows that can have links may meet their class; NaN and null would match by themselves.
    own = given.withColumn("_fit", usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    own = own.withColumn("_label", F.when(F.col("_fit"), F.col("label"))).drop("label")
    joined = own.join(named.withColumnRenamed("label", "_label"), ["_label", "vector"], "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

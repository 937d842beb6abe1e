"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents are sets of distinct two-word shingles; links join sets whose Jaccard similarity is
0.8 or more. Candidates come from a forest: each of ``TREES`` trees sorts the documents by its
own ``DEPTH`` min-hash values, and documents with a long common prefix there are neighbours.

* Equal sets are one node from the start, so copies cost nothing more.
* A region of a tree is what shares a prefix. It begins at ``SHALLOW`` values; a region with
  more than ``REGION_ROWS`` documents or ``REGION_SHINGLES`` in them is dealt by a longer prefix, so no task holds it whole.
  Inside a region, parts of at most ``ALL_PAIRS`` documents give all their pairs and larger ones
  split by the next value; neighbours in sorted order are candidates in any case. So pairs grow
  linearly with the documents, however large a group is.
* Every candidate is confirmed on the full sets.
* Regions of ``SHALLOW`` values that were too large for all pairs, dealt ones as a whole, are
  looked at again where their documents still fall into several components: all pairs across
  components are compared by signature there, and those that may reach the threshold on the
  full sets. The largest component is not compared with itself. A region beyond the bounds is
  cut into blocks and every two of them are a task's work, so that no pair is lost to the cut.
  A link that is found joins its components, so only links that join some leave a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brackenlog.llm.components import components, stored
from brackenlog.llm.tokens import BASES, Fingerprints, column_bytes, mixed, releasing, runs
from brackenlog.session import discard, fresh_dirs

SHINGLE = 2
THRESHOLD = 80
TREES, DEPTH, SHALLOW = 16, 8, 4
#: Rows of a region that one task takes, their shingles (8 bytes each), and rows of a part that
#: gives all its pairs.
REGION_ROWS, REGION_SHINGLES, ALL_PAIRS = 20_000, 20_000_000, 12
#: Ids up to this many (8 bytes each) are broadcast to pick documents; beyond it they are joined.
BROADCAST_IDS = 1_000_000
#: Share of equal values, of 128, from which on a pair is confirmed: three and a half sigma below 0.8.
SIGNATURE_SHARE = 0.676
CHUNK = 1 << 14
#: Bytes that name a region of ``SHALLOW`` values: its tree and those values.
HEAD = 2 + 4 * SHALLOW

_rng = np.random.default_rng(4)
_FACTORS = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64)


def shingles(text: bytes | None, memo: Fingerprints, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text with A-Z lowered; the whole of a shorter one."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    prints = memo.of(words)
    n = min(size, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(BASES[0]) + prints[k : k + len(h)]
    return np.unique(mixed(h ^ np.uint64(n)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hash values of non-empty sets, (sets, values) of 32 bits, most significant byte first."""
    out = np.empty((len(sets), len(_FACTORS)), ">u4")
    a = 0
    while a < len(sets):
        b, total = a + 1, len(sets[a])
        while b < len(sets) and total + len(sets[b]) <= CHUNK:
            total += len(sets[b])
            b += 1
        values = np.concatenate(sets[a:b])
        starts = np.cumsum([0, *(len(s) for s in sets[a : b - 1])])
        held = np.empty_like(values)
        for k, (factor, term) in enumerate(zip(_FACTORS, _TERMS)):
            np.multiply(values, factor, held)
            np.add(held, term, held)
            out[a:b, k] = np.minimum.reduceat(held, starts) >> np.uint64(32)
        a = b
    return out


def _signed(size: int):
    @releasing
    def run(batches):
        memo = Fingerprints()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), column_bytes(batch, "text")
            for a in range(0, len(ids), 1000):
                sets = [shingles(t, memo, size) for t in texts[a : a + 1000]]
                full = [s for s in sets if len(s)]
                signs = iter(signatures(full))
                rows = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), next(signs).tobytes()) if len(s) else (0, None, None) for s in sets]
                n, digest, sign = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 1000], pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sign, pa.binary())], ["doc_id", "n_shingles", "digest", "signature"])

    return run


def _parts(labels: np.ndarray, a: int, b: int, depth: int):
    """Parts ``[a, b)`` of sorted labels with at most ``ALL_PAIRS`` rows or nothing left to split by."""
    todo = [(a, b, depth)]
    while todo:
        a, b, depth = todo.pop()
        if b - a <= ALL_PAIRS or depth == labels.shape[1]:
            yield a, b
            continue
        heads = a + runs(labels[a:b, depth])
        todo += [(x, y, depth + 1) for x, y in zip(heads.tolist(), [*heads[1:].tolist(), b]) if y - x > 1]


@releasing
def _neighbours(batches):
    """Candidate pairs of the regions of a sorted stream, and the members of large or dealt regions."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("region", pa.binary())])

    def pairs(region: bytes, ids: np.ndarray, labels: np.ndarray):
        left, right = [np.arange(len(ids) - 1)], [np.arange(1, len(ids))]
        for a, b in _parts(labels, 0, len(ids), SHALLOW):
            if 2 < b - a <= ALL_PAIRS:
                x, y = np.triu_indices(b - a, 2)
                left.append(a + x)
                right.append(a + y)
        x, y = ids[np.concatenate(left)], ids[np.concatenate(right)]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.nulls(len(x), pa.binary())], schema=schema)
        if len(ids) > ALL_PAIRS or len(region) > HEAD:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array([region] * len(ids))], schema=schema)

    held = None
    for batch in batches:
        regions = batch.column("region").to_numpy(zero_copy_only=False)
        ids = batch.column("doc_id").to_numpy()
        labels = np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u4").reshape(len(ids), DEPTH)
        if not len(ids):
            continue
        heads = np.flatnonzero(np.r_[True, regions[1:] != regions[:-1]])
        cuts = [*heads[1:].tolist(), len(ids)]
        for a, b in zip(heads.tolist(), cuts):
            if held and held[0] == regions[a]:
                held = held[0], [*held[1], ids[a:b]], [*held[2], labels[a:b]]
                continue
            if held and (len(held[0]) > HEAD or sum(map(len, held[1])) > 1):
                yield from pairs(held[0], np.concatenate(held[1]), np.concatenate(held[2]))
            held = regions[a], [ids[a:b]], [labels[a:b]]
    if held and (len(held[0]) > HEAD or sum(map(len, held[1])) > 1):
        yield from pairs(held[0], np.concatenate(held[1]), np.concatenate(held[2]))


def forest(reps: DataFrame, region_rows: int = REGION_ROWS, size_column: str | None = None) -> DataFrame:
    """``a, b`` of candidates, and ``a, region`` of the members of large or dealt regions, from ``doc_id, signature``.

    A region is a tree and a prefix, so what was dealt shares its first ``HEAD`` bytes.

    ``size_column`` holds the size of a document's set, for the bound on a region.
    """
    size = 4 * DEPTH
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring("signature", t * size + 1, F.lit(size)).alias("label")))
    rows = reps.select("doc_id", (F.col(size_column) if size_column else F.lit(0)).alias("size"), F.explode(trees).alias("t")).select("doc_id", "size", "t.tree", "t.label")

    def region(depth, salt=None):
        head = F.concat(F.unhex(F.lpad(F.hex("tree"), 4, "0")), F.substring("label", 1, 4 * depth))
        return head if salt is None else F.concat(head, F.unhex(F.lpad(F.hex(salt), 16, "0")))

    done, rest = [], rows
    for depth in range(SHALLOW, DEPTH + 1, 2):
        rest = rest.withColumn("region", region(depth))
        load = F.greatest(F.count(F.lit(1)) / F.lit(region_rows), F.sum("size") / F.lit(REGION_SHINGLES))
        counts = rest.groupBy("region").agg(load.alias("load"), F.count(F.lit(1)).alias("n")).where("load > 1 AND n > 1").drop("n")
        hot = stored(counts, "hot-regions")
        if hot.isEmpty():
            done.append(rest)
            break
        done.append(rest.join(hot, "region", "left_anti"))
        rest = rest.join(hot, "region").select("doc_id", "size", "tree", "label", "load")
        if depth == DEPTH:
            # Equal labels throughout: neighbours are all alike, so blocks of them are cut by a
            # hash that differs from tree to tree.
            salt = F.pmod(F.xxhash64("doc_id", "tree"), F.ceil("load"))
            done.append(rest.withColumn("region", region(depth, salt)).drop("load"))
        rest = rest.drop("load")
    dealt = None
    for part in done:
        part = part.select("region", "label", "doc_id")
        dealt = part if dealt is None else dealt.unionByName(part)
    return dealt.repartition("region").sortWithinPartitions("region", "label", "doc_id").mapInArrow(_neighbours, "a long, b long, region binary")


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _sets(size: int):
    @releasing
    def run(batches):
        memo = Fingerprints()
        for batch in batches:
            ids, found, held, first = batch.column("doc_id").to_pylist(), [], 0, 0
            for at, text in enumerate(column_bytes(batch, "text"), 1):
                found.append(shingles(text, memo, size).tobytes())
                held += len(found[-1])
                if held >= 8 << 20 or at == len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[first:at], pa.int64()), pa.array(found, pa.binary())], ["doc_id", "hashes"])
                    found, held, first = [], 0, at

    return run


def _confirmed(threshold: int):
    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def confirm(docs: DataFrame, pairs: DataFrame, threshold: int = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """The ``pairs`` (``a, b``) of documents whose full sets reach the threshold."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")
    sets = stored(_picked(docs, ids).select("doc_id", "text").mapInArrow(_sets(size), "doc_id long, hashes binary"), "pair-sets")
    x = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirmed(threshold), "a long, b long")


def _blocks(placed: DataFrame, sizes: DataFrame, region_rows: int) -> DataFrame:
    """``doc_id, head, component, block, others``: regions with several components, in blocks.

    A region within the bounds is one block. Others have blocks of half the bounds, first those of
    the rest, then those of the largest component. ``others`` counts the blocks from 0 on that a
    block is compared with: all for one of the rest, those of the rest for one of the largest.
    """
    rows = placed.join(sizes.select("doc_id", F.col("high").alias("size")), "doc_id")
    parts = rows.groupBy("head", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    heads = parts.groupBy("head").agg(
        F.sum("n").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("components"), F.max(F.struct("n", "size", "component")).alias("top")
    ).where("components > 1")

    def needed(n, size):
        return F.ceil(F.greatest(2 * n / F.lit(region_rows), 2 * size / F.lit(REGION_SHINGLES), F.lit(1.0)))

    whole = (F.col("n") <= region_rows) & (F.col("size") <= REGION_SHINGLES)
    rest = F.when(whole, 1).otherwise(needed(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")))
    main = F.when(whole, 0).otherwise(needed(F.col("top.n"), F.col("top.size")))
    heads = heads.select("head", F.col("top.component").alias("largest"), rest.alias("rest"), main.alias("main"))
    salt, inside = F.xxhash64("doc_id", "head"), (F.col("component") == F.col("largest")) & (F.col("main") > 0)
    block = F.when(inside, F.col("rest") + F.pmod(salt, F.greatest("main", F.lit(1)))).otherwise(F.pmod(salt, F.col("rest")))
    others = F.when(inside, F.col("rest")).otherwise(F.col("rest") + F.col("main"))
    return placed.join(heads, "head").select("doc_id", "head", "component", block.cast("int").alias("block"), others.cast("int").alias("others"))


def _across(threshold: int):
    """Links between documents of two blocks, or of one, that so far are in different components."""

    def run(table: pa.Table) -> pa.Table:
        comp, counts = np.unique(table.column("component").to_numpy(), return_inverse=True, return_counts=True)[1:]
        inside = comp == counts.argmax()
        order, rest = np.argsort(inside, kind="stable"), int((~inside).sum())
        ids, comp, block = table.column("doc_id").to_numpy()[order], comp[order], table.column("block").to_numpy()[order]
        one = table.column("first")[0].as_py() == table.column("second")[0].as_py()
        tree = int.from_bytes(table.column("head")[0].as_py()[:2], "big")
        signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u4").reshape(len(ids), TREES * DEPTH)[order]
        held = [np.frombuffer(h, "<u8") for chunk in table.column("hashes").chunks for h in (v.as_buffer() for v in chunk)]
        sets = [held[k] for k in order.tolist()]
        sizes = np.array([len(s) for s in sets])
        left, right = [], []
        # The largest component comes last, and its documents are only partners.
        for i in range(rest):
            j = i + 1 + np.flatnonzero(comp[i + 1 :] != comp[i])
            j = j[(100 * sizes[j] >= threshold * sizes[i]) & (100 * sizes[i] >= threshold * sizes[j])]
            if not one:
                j = j[block[j] != block[i]]
            for a in range(0, len(j), 1 << 12):
                some = j[a : a + (1 << 12)]
                same = signs[some] == signs[i]
                alike = same.sum(1) >= SIGNATURE_SHARE * signs.shape[1]
                # Two documents meet in several trees; their pair belongs to that of the longest prefix.
                prefix = np.logical_and.accumulate(same[alike].reshape(-1, TREES, DEPTH), 2).sum(2)
                for k in some[alike][prefix.argmax(1) == tree].tolist():
                    if comp[k] == comp[i]:
                        continue
                    at = np.searchsorted(sets[i], sets[k])
                    both = int((sets[i][np.minimum(at, sizes[i] - 1)] == sets[k]).sum())
                    if 100 * both >= threshold * (sizes[i] + sizes[k] - both):
                        left.append(min(ids[i], ids[k]))
                        right.append(max(ids[i], ids[k]))
                        comp[comp == comp[k]] = comp[i]
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, size: int = SHINGLE, region_rows: int = REGION_ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest doc_id reachable by links, itself included.

    Defined cases: a null text or one without words has an empty set and is linked with nothing;
    a text with fewer words than a shingle is one shingle. A row without doc_id is linked with
    nothing and kept, its ``component_id`` is null. Rows that repeat a doc_id are judged by their
    own texts. Other columns are ignored. An empty table gives an empty result. ``region_rows``
    bounds a task, not the result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(docs.mapInArrow(_signed(size), "doc_id long, n_shingles long, digest binary, signature binary"), "signatures")
    own = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = own.groupBy("n_shingles", "digest").agg(F.min(F.struct("doc_id", "signature")).alias("m"))
    reps = stored(groups.select("n_shingles", "digest", "m.doc_id", "m.signature"), "representatives")
    found = stored(forest(reps, region_rows, "n_shingles"), "forest")
    sizes = reps.groupBy("doc_id").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))

    def fitting(pairs: DataFrame) -> DataFrame:
        """Without pairs whose sizes alone rule the threshold out."""
        x = sizes.select(F.col("doc_id").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"))
        y = sizes.select(F.col("doc_id").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"))
        return pairs.join(x, "a").join(y, "b").where((100 * F.col("ha") >= threshold * F.col("lb")) & (100 * F.col("hb") >= threshold * F.col("la"))).select("a", "b")

    tried = stored(fitting(found.where("b IS NOT NULL AND a <> b").select("a", "b").distinct()), "pairs")
    links = stored(confirm(docs, tried, threshold, size).distinct(), "confirmed")
    labels = stored(components(links), "components")
    members = found.where("region IS NOT NULL").select(F.col("a").alias("doc_id"), F.substring("region", 1, HEAD).alias("head")).distinct()
    placed = members.join(labels, F.col("doc_id") == F.col("node"), "left").select("doc_id", "head", F.coalesce("component", "doc_id").alias("component"))
    rows = stored(_blocks(stored(placed, "placed"), sizes, region_rows), "split-regions")
    if not rows.isEmpty():
        picked = _picked(docs, stored(rows.select("doc_id").distinct(), "split-ids"))
        sets = picked.select("doc_id", "text").mapInArrow(_sets(size), "doc_id long, hashes binary").where("length(hashes) > 0")
        full = stored(reps.select("doc_id", "signature").join(sets, "doc_id"), "split-sets")
        pair = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: F.struct(F.least("block", o).alias("first"), F.greatest("block", o).alias("second")))
        tasks = rows.select("doc_id", "head", "component", "block", F.inline(pair)).join(full, "doc_id")
        across = tasks.groupBy("head", "first", "second").applyInArrow(_across(threshold), "a long, b long")
        more = stored(across.where("a <> b").distinct(), "links-across")
        if not more.isEmpty():
            labels = stored(components(links.unionByName(more)), "components")
    named = reps.join(labels, F.col("doc_id") == F.col("node"), "left").select("n_shingles", "digest", F.coalesce("component", "doc_id").alias("component"))
    joined = signed.drop("signature").join(named, ["n_shingles", "digest"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, in full rows.

    The row with the smallest doc_id stays, nulls last and by a hash of the text on ties. Groups
    are of rows, not of ids: rows that repeat a doc_id with other texts are judged by their texts,
    and one of rows that are equal in both stays. Texts without words are near no other and stay.
    """
    node = F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("string"), F.col("text"))
    keyed = docs.withColumn("__node", node)
    names = stored(keyed.select(F.col("__node").alias("node"), F.col("doc_id").cast("long").alias("id")).groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "nodes")
    with fresh_dirs() as steps:
        found = near_duplicates(keyed.select(F.col("__node").alias("doc_id"), "text"), threshold, size)
    # Rows equal in id and text are one node there; only groups of several nodes are looked at.
    found = stored(found.select(F.col("doc_id").alias("node"), "component_id", "kept", "n_shingles").distinct(), "near-groups")
    # Signatures and sets take nearly as much disk as the texts; what follows reads the groups only.
    discard(docs.sparkSession, steps)
    groups = found.where("NOT kept").select("component_id").distinct()
    members = found.join(groups, "component_id").join(names, "node").select("component_id", "node", "id")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "node")).alias("m")).select(F.col("m.node").alias("node"))
    gone = stored(members.select("node").join(first, "node", "left_anti").select(F.col("node").alias("__node")), "near-copies")
    small = gone.count() <= BROADCAST_IDS
    rest = keyed.join(F.broadcast(gone) if small else gone, "__node", "left_anti")
    twice = stored(names.where("n > 1").join(found.where("n_shingles > 0"), "node", "left_semi").select(F.col("node").alias("__node")), "repeated-rows")
    if not twice.isEmpty():
        few = F.broadcast(twice) if twice.count() <= BROADCAST_IDS else twice
        repeated = rest.join(few, "__node", "left_semi").dropDuplicates(["__node"])
        rest = rest.join(few, "__node", "left_anti").unionByName(repeated)
    return rest.select(*(f"`{c}`" for c in docs.columns))

"""What must not depend on the size of a table, on copies, or on labels."""

from pathlib import Path

import numpy as np
import pytest
from llm import brute
from llm.test_text_operators import frame
from pyspark.sql import functions as F

import corpus_pipeline
from brackenlog.llm import lang_id, near_dedup, quality
from brackenlog.llm.substring_dedup import dedup_substrings
from brackenlog.llm.vector_dedup import near_duplicate_vectors, nearest_of, spread


def unit(a):
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def hot_group(count, dim, seed):
    """A third of the vectors crowd around one, the others come in close pairs."""
    rng = np.random.default_rng(seed)
    crowd = unit(unit(rng.normal(size=(1, dim))) + rng.normal(size=(count // 3, dim)) * np.sqrt(0.04 / dim))
    one = unit(rng.normal(size=(count // 3, dim)))
    two = unit(one + rng.normal(size=one.shape) * np.sqrt(0.05 / dim))
    return rng.permutation(np.vstack([crowd, one, two]))


@pytest.mark.parametrize("pivots", [32, 250, 1000])
def test_recall_of_vectors_whatever_the_number_of_pivots(spark, pivots):
    v = hot_group(1500, 32, pivots).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, row.tolist(), 1) for i, row in enumerate(v)], "vec_id long, embedding array<double>, label int")
    found = near_duplicate_vectors(df, tile=256, per_pivot=max(1, len(v) // pivots), most_pivots=1024).collect()
    truth = (unit(v) @ unit(v).T >= 0.93).sum(1) - 1
    got = np.zeros(len(v), int)
    for r in found:
        got[r.vec_id] = r.n_links
    assert (got <= truth).all() and got.sum() >= 0.95 * truth.sum()


def test_pivots_are_spread_and_describe_more_the_more_there_are():
    v = hot_group(3000, 16, 3)
    chosen = spread(v, 500)
    close = chosen @ chosen.T - np.eye(len(chosen))
    assert close.max() < 0.6 and [nearest_of(n) for n in (1, 8, 32, 256, 1024)] == [1, 8, 8, 14, 18]


def test_vectors_of_each_length_link(spark):
    rows = [(i, [1.0, 0.0, 0.01 * i, 0.0], 1) for i in range(6)] + [(10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.01, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(df).collect()}
    assert found == {i: (5, 0) for i in range(6)} | {10: (1, 10), 11: (1, 10)}


def words(seed, n=100):
    return [f"w{seed}x{k}" for k in range(n)]


def changed(text, at):
    return [f"new{k}" if k in at else w for k, w in enumerate(text)]


def test_near_duplicates_of_the_pipeline_are_of_five_words(spark):
    a, b = words(1), words(2)
    rows = [(1, " ".join(a)), (2, " ".join(changed(a, range(10, 100, 18)))), (3, " ".join(b)), (4, " ".join(changed(b, [50])))]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in rows])
    loose = {r.doc_id for r in near_dedup.keep_one(docs).collect()}
    assert loose == {1, 3}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, None).collect()} == {1, 2, 3}


def test_one_row_of_each_group_stays_though_ids_repeat(spark):
    a, b = " ".join(words(1)), " ".join(words(2))
    rows = [(3, a), (7, a + " z"), (7, b), (7, b), (None, b + " y"), (9, None), (9, None), (9, ""), (12, "1234")]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in rows])
    got = sorted(((r.doc_id, r.text) for r in near_dedup.keep_one(docs, size=5).collect()), key=str)
    assert got == sorted([(3, a), (7, b), (9, None), (9, None), (9, ""), (12, "1234")], key=str)


def test_what_near_duplicates_stored_on_the_way_is_given_back(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    a = words(3)
    docs = frame(spark, [(1, " ".join(a), "en", "s", 0), (2, " ".join(changed(a, [50])), "en", "s", 0), (3, " ".join(words(4)), "en", "s", 0)])
    kept = near_dedup.keep_one(docs, size=5)
    left = {p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before}
    assert {r.doc_id for r in kept.collect()} == {1, 3}
    assert left == {"nodes", "near-groups", "near-copies", "repeated-rows"}


def near_copies(count, seed):
    """Texts that lie on both sides of the threshold from one another, in some components, a few copies."""
    rng = np.random.default_rng(seed)
    base = words(0, 90)
    rows = []
    for k in range(count):
        some = rng.choice(90, rng.integers(1, 12), replace=False)
        rows.append((k, " ".join(f"v{k}q{i}" if i in some else w for i, w in enumerate(base))))
    return rows + [(count + n, text) for n, (_, text) in enumerate(rows[::40])]


@pytest.mark.parametrize("region_rows", [20_000, 30, 8])
def test_no_link_is_lost_to_the_bound_on_a_region(spark, region_rows):
    rows = near_copies(300, 6)
    sets = [brute.shingle_set(t) for _, t in rows]
    links = [(a, b) for b in range(len(rows)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    truth = brute.components(len(rows), links)
    assert 5 < len(set(truth)) < len(rows) - 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, region_rows=region_rows).collect()}
    assert [got[k] for k in range(len(rows))] == truth


def test_blocks_meet_once_and_the_largest_component_not_itself(spark):
    rows = [(k, b"h", 0 if k < 70 else k) for k in range(100)]
    placed = spark.createDataFrame(rows, "doc_id long, head binary, component long")
    sizes = spark.createDataFrame([(k, 5) for k in range(100)], "doc_id long, high long")
    got = {r.doc_id: (r.block, r.others) for r in near_dedup._blocks(placed, sizes, 20).collect()}
    assert {v[1] for k, v in got.items() if k < 70} == {3} and {v[1] for k, v in got.items() if k >= 70} == {10}
    assert all(v[0] >= 3 if k < 70 else v[0] < 3 for k, v in got.items()) and len(got) == 100
    assert {(r.block, r.others) for r in near_dedup._blocks(placed, sizes, 100).collect()} == {(0, 1)}
    assert near_dedup._blocks(placed.where("doc_id < 70"), sizes, 20).isEmpty()


def test_copies_crowd_no_language_out_of_the_sample(spark):
    one = frame(spark, [(1, "le même texte encore et encore", "fr", "s", 0)]).withColumn("doc_id", F.explode(F.sequence(F.lit(1), F.lit(30_000))))
    some = frame(spark, [(k, f"texte numéro {k} bien différent", "fr", "s", 0) for k in range(20)] + [(k, f"some text {k} of its own", "en", "s", 0) for k in range(300)])
    labels, _, y = lang_id.sample(one.unionByName(some).select("text", "lang"))
    counts = np.bincount(y, minlength=2)
    assert labels == ["en", "fr"] and counts[1] >= 21 and counts[0] >= 300


def test_nothing_is_dropped_for_want_of_labels(spark):
    docs = frame(spark, [(k, f"clean text number {k}", None, "s", 0) for k in range(50)] + [(90, "12 34", None, "s", 0), (91, None, None, "s", 0)])
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, None).collect()} == set(range(50))


def test_short_clean_documents_keep_their_language(spark):
    texts = {"en": "the cat sat on the mat and looked at the moon", "de": "der Hund lief durch den Wald und sah nicht zurück"}
    rows = [(k, f"{texts[lang]} {k}", lang, "s", 0) for lang in texts for k in range(40)]
    rows += [(500 + n, t, lang, "s", 0) for n, (lang, t) in enumerate([("en", "the moon"), ("en", "a cat"), ("de", "der Wald"), ("de", "und nicht")])]
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, frame(spark, rows), None).collect()}
    assert {500, 501, 502, 503} <= kept and len(kept) == 44


def test_fences_follow_their_group_both_ways(spark):
    def text(k, symbols):
        return " ".join(f"word{k}n{i}" + ("#" if i < symbols else "") for i in range(60))

    rows = [(k, text(k, 0), "en", "clean", 0) for k in range(200)] + [(900, text(900, 16), "en", "clean", 0)]
    rows += [(1000 + k, text(k, 10 + k % 12), "en", "tables", 0) for k in range(60)]
    rows += [(2000 + k, text(k, 60 if k % 3 == 0 else 0), "en", "junk", 0) for k in range(200)]
    docs = frame(spark, rows).repartition(3)
    first = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    # A rate of 0.27 passes a fixed cutoff of 0.3; among clean documents it does not.
    assert all(first[k] for k in range(200)) and not first[900]
    assert all(first[1000 + k] for k in range(60))
    # A source with a third of junk is not its own measure.
    assert not any(first[2000 + k] for k in range(0, 200, 3)) and all(first[2000 + k] for k in range(1, 200, 3))
    again = {r.doc_id: r.kept for r in quality.judge(docs.repartition(5, "text")).collect()}
    assert again == first


def test_words_may_fill_up_with_the_last_document_of_a_batch(spark):
    # Repeats are counted each FLUSH_WORDS words, and then nothing is left at the end of the batch.
    many = quality.FLUSH_WORDS
    rows = [(1, "a b c d e a b c d e", "en", "s", 0), (2, "w " * many, "en", "s", 0)]
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality.judge(frame(spark, rows).coalesce(1)).collect()}
    assert got == {1: (10, 10), 2: (many, many)}
    assert quality._repeated([]) == []


def test_quantiles_are_near_those_of_the_values(spark):
    rng = np.random.default_rng(1)
    values = np.r_[np.zeros(30), rng.lognormal(size=2000)]
    df = spark.createDataFrame([("en", "s", 10, float(v), 0.0, 0.0, 5.0) for v in values], "lang string, source string, n_words long, symbol_rate double, dup_line_rate double, repeat_rate double, mean_word double").repartition(4)
    row = quality.quartiles(quality.sketches(df), ["lang"]).first()
    for name, q in (("symbol_rate_q1", 25), ("symbol_rate_q3", 75)):
        want = np.percentile(values, q, method="inverted_cdf")
        assert abs(row[name] - want) <= 1.01 * quality.ACCURACY * want
    assert row.n == len(values) and row.dup_line_rate_q3 == 0 and abs(row.mean_word_q1 - 5) < 0.03


def test_more_text_makes_more_buckets_and_the_same_result(spark, monkeypatch):
    from brackenlog.llm import substring_dedup

    shared = [f"s{k}" for k in range(40)]
    rows = [(k, " ".join([f"a{k}x{i}" for i in range(20)] + shared[k % 9 :])) for k in range(60)] + [(None, " ".join(shared)), (None, " ".join(shared)), (4, "other text")]
    monkeypatch.setattr(substring_dedup, "BUCKET_CHARS", 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in dedup_substrings(docs).collect()), key=str)
    assert got == sorted(brute.substring_dedup(rows, 13), key=str)

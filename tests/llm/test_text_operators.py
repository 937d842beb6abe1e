import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm import brute
from pyspark.sql import functions as F

from brackenlog.llm import lang_id, mixing, pieces, quality, token_store
from brackenlog.llm.near_dedup import keep_one, near_duplicates
from brackenlog.llm.substring_dedup import dedup_substrings, intervals

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def corpus(seed=0, n=60):
    """Texts of a small vocabulary with copies, near copies, shared passages, empties and nulls."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("the of a b cd ef gh Ij é 漢".split()) for _ in range(rng.choice((0, 1, 2, 13, 40, 90)))) for _ in range(n)]
    passage = " ".join(f"p{k}" for k in range(30))
    for k in range(0, n, 5):
        texts[k] += "\n" + passage
    for k in range(1, n, 7):
        texts[k] = texts[k - 1] if k % 2 else texts[k - 1].replace("the", "THE", 2)
    texts[3] = None
    texts[4] = " \t\n "
    return [(None if k == 9 else k // 2 * 2 if k in (20, 21) else k, t, rng.choice(("en", "fr", None)), rng.choice(("s", "t", None)), 0) for k, t in enumerate(texts)]


def test_substring_dedup_equals_brute_force(spark):
    rows = corpus()
    got = dedup_substrings(frame(spark, rows), window=13).collect()
    want = brute.substring_dedup([(r[0], r[1]) for r in rows], 13)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got], key=key) == sorted(want, key=key)
    for r in got:
        assert sum(b - a for a, b in r.intervals) == r.n_removed
        assert all(x.end < y.start for x, y in zip(r.intervals, r.intervals[1:]))


def test_substring_dedup_keeps_columns_and_untouched_texts(spark):
    rows = [(1, "a  b", "en", "s", 4), (2, None, None, None, None)]
    got = {r.doc_id: r for r in dedup_substrings(frame(spark, rows), keep=("lang", "source"), rejoin=False).collect()}
    assert got[1].kept_text == "a  b" and got[1].lang == "en" and got[2].kept_text is None
    clash = frame(spark, rows).select("doc_id", "text", F.lit(1).alias("dest"), F.lit(2).alias("blob"), F.lit(3).alias("n_words"))
    assert dedup_substrings(clash).count() == 2
    assert dedup_substrings(frame(spark, [])).count() == 0


def test_a_very_long_text_and_intervals(spark):
    long = " ".join(f"w{k % 5000}" for k in range(60_000))
    got = {r.doc_id: r for r in dedup_substrings(frame(spark, [(1, long, None, None, 0), (2, "x " + long + " y", None, None, 0)])).collect()}
    assert got[1].n_removed == 0 and got[2].kept_text == "x y" and [tuple(i) for i in got[2].intervals] == [(1, 60_001)]
    mask, spans = intervals(np.array([0, 1, 9]), 14, 3)
    assert mask.nonzero()[0].tolist() == [0, 1, 2, 3, 9, 10, 11] and spans.tolist() == [[0, 4], [9, 12]]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    base = [[f"v{rng.randrange(300)}" for _ in range(80)] for _ in range(12)]
    rows = []
    for k in range(150):
        text = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4, 8, 30))):
            text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(text), None, None, 0))
    rows += [(200, None, None, None, 0), (201, "", None, None, 0), (202, "One", None, None, 0), (203, "oNe", None, None, 0), (None, "one", None, None, 0), (7, rows[7][1], None, None, 0)]
    got = near_duplicates(frame(spark, rows)).collect()
    sets = {r[0]: brute.shingle_set(r[1]) for r in rows if r[0] is not None}
    ids = sorted(sets)
    links = [(a, b) for a in range(len(ids)) for b in range(a) if sets[ids[a]] and 100 * len(sets[ids[a]] & sets[ids[b]]) >= 80 * len(sets[ids[a]] | sets[ids[b]])]
    at = brute.components(len(ids), links)
    want = {i: ids[at[k]] for k, i in enumerate(ids)}
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    kept = keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    # The row without doc_id has the text of another one, whose group keeps the smallest id.
    assert {r.doc_id for r in kept.collect()} == {i for i in ids if want[i] == i}
    assert near_duplicates(frame(spark, [])).count() == 0


def test_regions_split_and_links_across_parts(spark):
    """With tiny regions and parts, candidates come from deeper levels and the second look."""
    from brackenlog.llm import near_dedup

    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(60):
        text = list(words)
        text[3 * k] = f"x{k}"
        rows.append((k, " ".join(text), None, None, 0))
    found = near_dedup.near_duplicates(frame(spark, rows)).select("component_id").distinct().collect()
    assert [r.component_id for r in found] == [0]
    signed = frame(spark, rows).select("doc_id", "text").mapInArrow(near_dedup._signed(2), "doc_id long, n_shingles long, digest binary, signature binary")
    small = near_dedup.forest(signed.select("doc_id", "signature"), region_rows=10)
    pairs = {(r.a, r.b) for r in small.where("b IS NOT NULL").collect()}
    assert pairs and all(0 <= a < b < 60 for a, b in pairs)


def test_language_network_gradient_and_pooling():
    net = lang_id.Network.fresh(["a", "b"], seed=1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x = np.array([[65, 66, lang_id.PAD], [66, 67, 68]]).T
    y = np.array([0, 1])
    _, grad = net.loss_and_gradient(x, y)
    for name, place in (("hzf", (0, 1)), ("hnb", (2, 3)), ("xrf", (66, 1)), ("xnb", (65, 0)), ("of", (1, 0)), ("bias", (1,))):
        kept = net.weights[name][place]
        loss = []
        for step in (1e-3, -1e-3):
            net.weights[name][place] = kept + step
            loss.append(net.loss_and_gradient(x, y)[0])
        net.weights[name][place] = kept
        assert abs((loss[0] - loss[1]) / 2e-3 - grad[name][place]) < 2e-4, name
    p = net.pooled([b"", b"abc" * 500, b"x"])
    assert p[0].tolist() == [0, 0] and np.allclose(p[1:].sum(1), 1, atol=1e-4)


def test_language_id_learns_and_handles_odd_rows(spark):
    rng = random.Random(2)
    vocab = {"en": "the and of with from".split(), "fr": "les une dans pour être".split()}
    rows = [(k, " ".join(rng.choices(vocab[lang], k=40)), lang, "s", 0) for k in range(120) for lang in [rng.choice(("en", "fr"))]]
    docs = frame(spark, rows).withColumn("held", lang_id.held_out("doc_id"))
    assert {r.doc_id for r in docs.where("held").collect()} == {k for k in range(120) if zlib.crc32(str(k).encode()) % 4 == 2}
    net = lang_id.train(docs.where("NOT held").select("text", "lang"))
    odd = [(900, None, None, None, 0), (901, "123 ...", "en", None, 0), (902, "", None, None, 0), (None, "the and of", None, None, 0)]
    both = frame(spark, rows + odd).withColumn("score", F.lit("clash"))
    got = lang_id.predict(both, net).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (900, 901, 902))
    assert by[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    nothing = lang_id.train(frame(spark, []).select("text", "lang"))
    assert {r.lang_pred for r in lang_id.predict(frame(spark, rows[:3]), nothing).collect()} == {"und"}
    assert lang_id.predict(frame(spark, []), net).count() == 0


def test_quality_counts_equal_brute_force_and_thresholds_adapt(spark):
    rows = corpus(3) + [(500, "a b c d e " * 6, "en", "s", 0), (501, "x\nx\n\n x\nx", "en", "s", 0), (502, "a#b * <c> | d", None, None, 0)]
    rows += [(600 + k, " ".join(f"clean{k}w{i}" for i in range(30)), "en", "big", 0) for k in range(60)]
    rows += [(700, " ".join(f"noise{i}###" for i in range(30)), "en", "big", 0)]
    got = quality.judge(frame(spark, rows).withColumn("kept", F.lit(1)).withColumn("_lang", F.lit(2))).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words))
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(brute.quality(r[1]))
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[600 + k] for k in range(60)) and not kept[700]
    assert quality.judge(frame(spark, [])).count() == 0


def test_mixing_targets_and_sampling(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.choice((0, 1, 5, 50, 200))), None, rng.choice(("a", "é", "b", "z", None, "tiny") if k % 40 == 0 else ("a", "é", "b", None)), 0) for k in range(900)]
    rows += [(5, rows[5][1], None, rows[5][3], 0), (None, "x y", None, "a", 0), (901, None, None, "b", 0)]
    docs = frame(spark, rows).withColumn("size", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        n = len(brute.words(r.text))
        sizes[r.source] = sizes.get(r.source, 0) + n
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.size == n and r.taken == r.copies * n and 0 <= r.copies <= 3
    want = brute.mix_targets(sizes, (5, 2, 1), 3)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - target[s]) <= 400
    again = mixing.mix(docs.repartition(7)).collect()
    order = lambda rs: sorted((r.doc_id is None, r.doc_id or 0, r.copies) for r in rs)
    assert order(again) == order(got)
    out = mixing.emit(mixing.mix(frame(spark, rows)))
    assert out.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") and out.count() == sum(r.copies for r in got)
    assert mixing.mix(frame(spark, [])).count() == 0
    assert {r.target for r in mixing.mix(frame(spark, [(1, None, None, "a", 0)])).collect()} == {0.0}


def test_directly_addressable_codes():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 2 ** rng.integers(1, 32, 4000)).astype("<u4")
    data = token_store.pack_segment([5, None, -3], [ids[:3000].tobytes(), b"", ids[3000:].tobytes()])
    s = token_store.Segment(data)
    assert s.doc_ids == [5, None, -3] and s.counts.tolist() == [3000, 0, 1000]
    assert (s.all() == ids).all() and all(s.token(i) == ids[i] for i in range(0, 4000, 7))
    with pytest.raises(IndexError):
        s.token(4000)
    with pytest.raises(ValueError):
        token_store.Segment(b"JUNK" + data)
    empty = token_store.Segment(token_store.pack_segment([], []))
    assert empty.tokens == 0 and len(empty.all()) == 0
    both = data + b"\n" + data + b"\n"
    assert [len(x.all()) for x in token_store.segments(both)] == [4000, 4000]


def test_new_words_of_many_texts_are_asked_for_together(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = [None, "", " \n", "<|endoftext|>, A<|ENDOFTEXT|>b x<|startoftext|>.", "Ärger!, É. ß,,  x , 漢字, S !!! a'b c'S \x1c\x1d,", "\u0301 e\u0301, İ. K. x\x00, \x7f. "]
    texts = odd + [f"word{k}, Word{k}! and word{k % 7}... zy{'x' * k}\n" for k in range(300)] + odd
    monkeypatch.setattr(token_store, "CHUNK_BYTES", 3000)
    tool, alone, asked = token_store.Encoder(path), Tokenizer.from_file(path), []
    ids = tool._ids
    monkeypatch.setattr(tool, "_ids", lambda some: asked.append(len(some)) or ids(some))
    for most in (800_000, 50):
        monkeypatch.setattr(token_store, "MEMO_PARTS", most)
        got = [list(np.frombuffer(b, "<u4")) for b in tool.encode(pa.array(texts)[1:])]
        assert got == [alone.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]
        if most > 50:
            assert len(asked) < 20 and sum(asked) < 800


def test_token_files_equal_the_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello WORLD's\u00a0end", None, "", "e\u0301 ß 漢字 a<|endoftext|>b 12,5", "x\ty\n\nz " * 300, "Hello"]
    rows = [(k * 3 - 4, t, None, None, 0) for k, t in enumerate(texts)] + [(None, "null id", None, None, 0), (2, "again", None, None, 0)]
    token_store.write(frame(spark, rows).withColumn("segment", F.lit(1)), str(tmp_path / "t"), path)
    got = sorted(token_store.read(spark, str(tmp_path / "t"), with_ids=True).collect(), key=lambda r: r.start)
    tool = Tokenizer.from_file(path)
    at = 0
    for r, (i, t, *_) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    token_store.write(frame(spark, []), str(tmp_path / "e"), path)
    assert token_store.read(spark, str(tmp_path / "e")).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def full_search(v, text):
    """The best path over the whole text at once."""
    if not text:
        return []
    text = " " + text
    cost, back = [0] + [None] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - v.longest), end):
            found = v.pieces.get(text[begin:end])
            if found and (cost[end] is None or cost[begin] + found[0] < cost[end]):
                cost[end], back[end] = cost[begin] + found[0], (begin, [found[1]])
        if text[end - 1] not in v.pieces:
            ids = v.fallback(text[end - 1])
            total = cost[end - 1] + v.byte_cost * len(ids)
            if cost[end] is None or total < cost[end]:
                cost[end], back[end] = total, (end - 1, ids)
    out, end = [], len(text)
    while end:
        end, ids = back[end]
        out = ids + out
    return out


def test_streaming_search_equals_the_full_one(vocabulary):
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice("the ing éß\n\t  ▁漢字😀aeiouAE.,0x") for _ in range(rng.randrange(120)))
        ids = np.frombuffer(vocabulary.encode(text.encode()), "<i4").tolist()
        assert ids == full_search(vocabulary, text)
        assert vocabulary.decode(ids) == text.encode()
        if text:
            assert [i for part in vocabulary.stream(" " + text) for i in part] == ids


def test_streaming_search_gives_ids_before_the_end(vocabulary):
    given = 0

    def chars():
        nonlocal given
        for c in "internationalization" * 500:
            given += 1
            yield c

    first = next(vocabulary.stream(chars()))
    assert first and given < 10 * vocabulary.longest


def test_encoding_frames(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, "Hello  world\n", "en", "s", 0), (None, None, None, None, 0), (2, "", None, None, 0), (1, "Hello  world\n", "en", "s", 0), (3, "ab" * 40_000, None, None, 0)]
    found = pieces.encode(frame(spark, rows).withColumn("ids", F.lit(1)), path, ("doc_id", "lang"))
    got = found.collect()
    assert [r.n_tokens for r in got if r.doc_id == 2] == [0] and len(got) == 5
    assert all(r.round_trip for r in got if r.doc_id is not None)
    assert [(r.ids, r.round_trip) for r in got if r.doc_id is None] == [(None, None)]
    back = {r.doc_id: r.text for r in pieces.decode(found, path).collect()}
    assert back == {1: "Hello  world\n", 2: "", 3: "ab" * 40_000, None: None}
    assert pieces.encode(frame(spark, []), path).count() == 0

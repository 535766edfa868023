import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidewater.llm import ann, bpe, langid, media, mixing, near, repeats, sharding, url_filter, warc
from tidewater.llm.components import components
from tidewater.llm.suffix import suffix_arrays

from . import brute

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows(df):
    return [tuple(r) for r in df.collect()]


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n)) if vocabulary else ""


# -- suffix arrays and repeats


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=8))
def test_suffix_arrays(strings):
    bounds = np.cumsum([0] + [len(s) for s in strings])
    found = suffix_arrays(np.array([c for s in strings for c in s], np.int64), bounds)
    assert list(found) == [bounds[i] + k for i, s in enumerate(strings) for k in sorted(range(len(s)), key=lambda k: s[k:])]


@pytest.mark.parametrize("block", [4096, 300])
def test_earlier_windows(monkeypatch, block):
    """Classes of equal windows around one anchor, also when the group is dealt out."""
    monkeypatch.setattr(repeats, "BLOCK", block)
    rng = random.Random(block)
    core = bytes(rng.randrange(97, 123) for _ in range(70))
    vary = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    left = [vary(4) for _ in range(3)]
    texts = []
    for _ in range(12):
        a, b = rng.choice(left), vary(3) + b"x" * 40
        texts.append(b"q" * 30 + a + core + b)  # the anchor is where core starts
    items = []
    for n, t in enumerate(texts):
        at = 34
        low, high = rng.randrange(-30, -20), rng.randrange(-10, 1)
        items.append((n, low, t[at + low : at + high + 100]))
    place = [(rng.randrange(5), 0, n) for n in range(len(items))]
    found = set()
    for i, a, b in repeats.earlier([list(range(len(items)))], place, list(range(len(items))), [x[1] for x in items], [x[2] for x in items]):
        found |= {(i, j) for j in range(a, b + 1)}
    window = lambda i, j: items[i][2][j - items[i][1] :][:100]
    spots = [(i, j) for i in range(len(items)) for j in range(items[i][1], items[i][1] + len(items[i][2]) - 99)]
    assert found == {(i, j) for i, j in spots if any(j == k and place[o] < place[i] and window(o, k) == window(i, j) for o, k in spots)}


def test_contexts_without_a_common_window():
    """Contexts of one anchor that share less than a window, alone and beside a group that does match."""
    rng = random.Random(9)
    vary = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    seed = vary(48)
    apart = [vary(40) + seed + vary(40) for _ in range(2)]
    place = [(i, 0, 0) for i in range(4)]
    assert [*repeats.earlier([[0, 1]], place, [0, 1], [-40, -40], apart)] == []
    same = vary(110)
    data = [*apart, same + vary(9), same + vary(9)]
    assert sorted(repeats.earlier([[0, 1], [2, 3]], place, [0, 1, 2, 3], [-40, -40, 0, 0], data)) == [(3, 0, 10)]


def test_documents_that_share_less_than_a_window(spark):
    rng = random.Random(10)
    vary = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    seed = vary(60)
    docs = [(i, vary(300) + seed + vary(300)) for i in range(4)]
    found = {r[0]: r[1:5] for r in rows(repeats.remove(spark.createDataFrame(docs, "doc_id bigint, text string")))}
    assert found == {i: v[:4] for i, v in brute.repeats(docs).items()} and not any(v[1] for v in found.values())


def repeat_docs():
    a, b = words(60, 1), words(400, 2)
    return [
        (1, a), (2, "x " + a + " y"), (3, b), (4, b), (5, b[:500] + " cut " + b[500:]), (6, None), (7, ""), (8, "é" * 130), (9, "é" * 60 + a), (10, "z" * 5000), (11, "z" * 99), (12, "z" * 100),
        (13, a[:100]), (14, a[1:100]), (15, "ab" * 400), (16, b[100:210] + words(30, 3) + b[100:210]), (-5, b[300:420]), (17, words(20000, 4)), (18, "short"), (19, "short"),
    ]


@pytest.mark.parametrize("hot, crowd, piece", [(512, 512, 1 << 20), (1, 512, 300), (1, 1, 1 << 20)])
def test_repeats(spark, monkeypatch, hot, crowd, piece):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "PIECE", piece)
    docs = repeat_docs()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS).withColumn("ord", F.lit(1)).withColumn("copy", F.lit("x")).repartition(3)
    found = {r[0]: (*r[1:5], r[5]) for r in rows(repeats.remove(df, with_kept=True))}
    assert found == {i: (*v[:4], v[4].decode("utf-8", "ignore")) for i, v in brute.repeats(docs).items()}


@pytest.mark.parametrize("crowd", [512, 1])
def test_repeats_with_filled_filters(spark, monkeypatch, crowd):
    """Filters that let everything pass change nothing."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats.bloom, "build", lambda keys, n: np.full(1 << 16, 255, np.uint8))
    line = words(20, 70)[:130]
    docs = repeat_docs() + [(200 + i, words(12, 400 + i % 5) + " " + line + " " + words(12, 500 + i)) for i in range(12)]
    found = {r[0]: r[1:5] for r in rows(repeats.remove(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)))}
    assert found == {i: v[:4] for i, v in brute.repeats(docs).items()}


def test_pieces_have_the_anchors_of_the_whole(monkeypatch):
    rng = np.random.default_rng(6)
    for data in (rng.integers(97, 100, 20_000), np.full(5000, 122), np.tile(rng.integers(0, 256, 70), 90)):
        data = data.astype(np.uint8)
        whole = repeats.Anchors(data)
        for piece in (150, 1000, 4096):
            monkeypatch.setattr(repeats, "PIECE", piece)
            parts = [*repeats.anchors(data)]
            for name in ("low", "high", "gram", "context"):
                assert (np.concatenate([getattr(a, name) for a in parts]) == getattr(whole, name)).all()
            assert (np.concatenate([a.at + a.base for a in parts]) == whole.at).all()


def test_a_common_line_in_ever_different_surroundings(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 4)
    monkeypatch.setattr(repeats, "CROWD", 6)
    rng = random.Random(12)
    vary = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    line = vary(125)
    docs = [(i, vary(rng.randrange(60, 200)) + line + vary(rng.randrange(60, 200))) for i in range(40)] + [(100, line), (101, vary(30) + line[:104])]
    found = {r[0]: r[1:5] for r in rows(repeats.remove(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)))}
    assert found == {i: v[:4] for i, v in brute.repeats(docs).items()}


def test_fifty_megabytes_in_bounded_memory():
    """Anchors and shingles of one long text, part by part."""
    import resource

    rng = np.random.default_rng(8)
    words_ = np.array([bytes(rng.integers(97, 123, 9).astype(np.uint8)).decode() for _ in range(5000)])
    text = " ".join(words_[rng.integers(0, 5000, 5_000_000)])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = sum(len(a.at) for a in repeats.anchors(np.frombuffer(text.encode(), np.uint8)))
    assert n > len(text) // 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
    owner, value, weight = near.shingles([text])
    assert weight.sum() == 5_000_000 - 4 and (np.diff(value.astype(object)) > 0).all() and near.signatures(owner, value, weight, 1).any()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_200_000


def test_repeats_of_null_and_repeated_ids(spark):
    a = words(60, 1)
    df = spark.createDataFrame([(None, a), (3, a), (3, a), (3, "other " + a), (None, None)], "doc_id bigint, text string")
    found = Counter(r[:3] for r in rows(repeats.remove(df)))
    n = len(a)
    assert found[(None, n, 0)] == 1 and found[(3, n, n)] == 2 and found[(3, n + 6, n)] == 1 and found[(None, 0, 0)] == 1
    assert rows(repeats.remove(df.limit(0))) == []


# -- near duplicates


def near_docs():
    rng = random.Random(7)
    base = words(200, 11).split()
    docs = [(i, words(120, 100 + i)) for i in range(20)]
    for i in range(30):  # a chain of changing copies
        base = list(base)
        for _ in range(3):
            base[rng.randrange(len(base))] = f"w{rng.randrange(10**6)}"
        docs.append((100 + i, " ".join(base)))
    docs += [(200, docs[3][1].upper()), (201, "  " + docs[3][1].replace(" ", "\n")), (202, "one two"), (203, "One  two"), (204, "one two three"), (205, None), (206, ""), (207, " \n"), (208, "la " * 50), (209, "la " * 52), (210, "la " * 3000), (211, words(9000, 5)), (212, words(9000, 5) + " end")]
    return docs


@pytest.mark.parametrize("leaders", [(1, 6), ()])
def test_near_duplicates(spark, monkeypatch, leaders):
    monkeypatch.setattr(near, "LEADERS", leaders)
    docs = near_docs()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS).withColumn("node", F.lit(1)).repartition(3)
    assert {r.doc_id: r.class_id for r in near.classes(df).collect()} == brute.near(docs)


@pytest.mark.parametrize("least", [0.0, 0.5])
def test_near_duplicates_in_blocks(spark, monkeypatch, least):
    """Buckets of many unlike texts that share a passage, in small parts; without the signature test as well."""
    monkeypatch.setattr(near, "LEADERS", (1,))
    monkeypatch.setattr(near, "PART", 5)
    common = words(60, 50)
    docs = [(i, common + " " + words(25, 300 + i)) for i in range(14)] + [(100 + i, common + " " + words(25, 300 + i) + f" more{i}") for i in range(0, 14, 3)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    found = {r.doc_id: r.class_id for r in near.classes(df, least=least).collect()}
    assert found == brute.near(docs) and len(set(found.values())) < len(found)


def test_similarities_of_a_block():
    texts = [near.canonical(t) for t in ("a b c d e f g h", "a b c d e f g x", "q", "a b c d e f g h a b c d e f", "q r", "la la la la la la la", "a b c d e f g h")]
    sets = near._Sets(texts)
    for i in range(len(texts)):
        others = np.array([j for j in range(len(texts)) if j != i])
        want = [brute.probability_jaccard(brute.shingles(texts[i]), brute.shingles(texts[j])) for j in others]
        assert sets.similarities(i, others) == pytest.approx(want)


def test_shingles_of_long_texts(monkeypatch):
    text = words(3000, 20) + " " + "x" * 9000 + " " + words(500, 21)
    whole = near.shingles([near.canonical(text)])
    marks = near.signatures(*whole, 1)
    monkeypatch.setattr(near, "CHARS", 700)
    monkeypatch.setattr(near, "SHINGLES", 100)
    parts = near.shingles(["a b", near.canonical(text), "c"])
    mine = parts[0] == 1
    assert (parts[1][mine] == whole[1]).all() and (parts[2][mine] == whole[2]).all() and (near.signatures(*parts, 3)[1] == marks).all()


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_large_class_is_spread_over_tasks(spark, monkeypatch, broadcast):
    texts = ["the same words in every copy of this text"] * 4000 + [f"another text of its own is number {i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    if not broadcast:
        monkeypatch.setattr(near, "few", lambda keys: keys)
    adaptive = "spark.sql.adaptive."
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.files.openCostInBytes": "16m", adaptive + "coalescePartitions.enabled": "false", adaptive + "advisoryPartitionSizeInBytes": "16k", adaptive + "skewJoin.skewedPartitionThresholdInBytes": "16k", adaptive + "skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = near.classes(df).select("doc_id", "class_id", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: r.class_id for r in found} == {i: 0 if i < 4000 else i for i in range(4400)}
    assert max(Counter(r.task for r in found if r.class_id == 0).values()) < 2500


def test_signatures_of_copies_do_not_meet(spark, monkeypatch):
    plans, plain = {}, near.written

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        return plain(df, name)

    monkeypatch.setattr(near, "written", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near.classes(spark.createDataFrame([(i, f"words that all of them have and {i % 2}") for i in range(20)], "doc_id long, text string"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    place = {op: [i for i, line in enumerate(plans["near-signatures"]) if op in line] for op in ("Join", "Aggregate")}
    assert place["Join"] and place["Aggregate"] and max(place["Join"]) < min(place["Aggregate"])


def test_near_duplicates_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "A b  c"), (4, "A b  c"), (2, "x"), (None, None), (None, None)], "doc_id bigint, text string")
    assert Counter((r.doc_id, r.class_id) for r in near.classes(df).collect()) == {(None, 4): 1, (4, 4): 2, (2, 2): 1, (None, None): 2}
    assert near.classes(df.limit(0)).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    values = np.sort(rng.integers(0, 1 << 62, 3000).astype(np.uint64))
    errors = []
    for share in (0.5, 0.2, 0.8):
        for _ in range(10):
            a, b = rng.random(3000) < 0.5, rng.random(3000)
            b = np.where(b < share, a, rng.random(3000) < 0.5)
            wa, wb = rng.integers(1, 4, 3000).astype(float), None
            wb = np.where(rng.random(3000) < 0.8, wa, 1.0)
            x, y = (values[a], wa[a]), (values[b], wb[b])
            s = near.signatures(np.concatenate([np.zeros(a.sum(), int), np.ones(b.sum(), int)]), np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]), 2)
            truth = near.similarity(x, y)
            count = lambda v: Counter(dict(zip(v[0].tolist(), v[1].tolist())))
            if share == 0.5 and not errors:
                few = lambda v: (v[0][:60], v[1][:60])
                assert abs(near.similarity(few(x), few(y)) - brute.probability_jaccard(count(few(x)), count(few(y)))) < 1e-9
            errors.append((s[0] == s[1]).mean() - truth)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 9)] + [(7, 7)]
    found = dict(rows(components(spark.createDataFrame(chain, "a int, b int"))))
    assert found == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 9)}


# -- mixing


def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["a", "b", "c", "d", None]), rng.choice([0, 1, 5, 50, 400])) for i in range(300)] + [(1000, "e", 5000), (1001, "f", 0), (None, "a", 3)]
    df = spark.createDataFrame([(i, " ".join(["w"] * n) if n else rng.choice([None, "", " \n"]), s) for i, s, n in docs], "doc_id bigint, text string, source string").withColumn("size", F.lit("clash")).repartition(3)
    found = mixing.mix(df).collect()
    want = brute.mix(docs)
    assert {r.doc_id: list(r.takes) for r in found} == want
    assert sum(sum(r.takes) for r in found) == int(1.5 * sum(d[2] for d in docs)) and all(sum(r.takes) <= 2 * r["size"] for r in found)
    goal = brute.targets({s: sum(n for _, t, n in docs if t == s) for s in {d[1] for d in docs}})
    source = {i: s for i, s, _ in docs}
    assert all(abs(r.target - goal[source[r.doc_id]]) < 1e-6 for r in found)


def test_mix_of_nothing_and_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (2, None, "t")], "doc_id bigint, text string, source string")
    found = mixing.mix(df).collect()
    assert len(found) == 3 and sum(sum(r.takes) for r in found if r.doc_id == 1) in (6, 7, 8) and [list(r.takes) for r in found if r.doc_id == 2] == [[0, 0]]
    assert mixing.mix(df.limit(0)).count() == 0 and [sum(r.takes) for r in mixing.mix(df.where("doc_id = 2")).collect()] == [0]


def test_mix_stays_in_the_jvm(spark):
    plan = mixing.mix(spark.createDataFrame([(1, "a b", "s")], "doc_id bigint, text string, source string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# -- BPE


@pytest.fixture(scope="module")
def coders():
    from tokenizers import Tokenizer

    path = bpe.public_vocabulary()
    return bpe.WordBpe(path), Tokenizer.from_file(path)


ALPHABET = [*"aAbBéÉΣσ 1²½'", "'s", "'LL", "\x1c", "\x85", "\u3000", "\u0301", "가", "<|startoftext|>", "<|endoftext|>", "<|", "\n", "日", "th", "ing", "\u0558"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40))
def test_bpe_agrees_with_the_library(coders, parts):
    ours, theirs = coders
    text = "".join(parts)
    want = theirs.encode(text, add_special_tokens=False)
    ids, decoded = ours.encode(text)
    assert ids == struct.pack(f"<{len(want.ids)}I", *want.ids) and decoded == theirs.decode(want.ids, skip_special_tokens=False) == ours.decode(want.ids)


def test_bpe_of_letters_newer_than_python(coders):
    """Every code point that Python's tables do not know."""
    import unicodedata

    ours, theirs = coders
    texts = [f"a{c}b1{c}2" for cp in range(0x378, 0x33500) if unicodedata.category(c := chr(cp)) == "Cn"]
    wrong = [t for t, want in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True) if ours.ids(t) != struct.pack(f"<{len(want.ids)}I", *want.ids)]
    assert not wrong


def test_bpe_of_long_words(coders, monkeypatch):
    ours, theirs = coders
    text = "th" * 3000 + "eer" * 500
    want = theirs.encode(text, add_special_tokens=False).ids
    assert ours.merged(text.encode()) == want
    short = [w for w in words(200, 1).split()] + ["a", "internationalization"]
    monkeypatch.setattr(bpe, "LONG", 1)
    by_heap = [ours.merged(w.encode()) for w in short]
    monkeypatch.setattr(bpe, "LONG", 10**6)
    assert by_heap == [ours.merged(w.encode()) for w in short]


def test_bpe_operator(spark, coders):
    texts = [None, "", " \n", "Hello world", "Hello world", words(3000, 1), "<|endoftext|>x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("key", F.lit(1)).withColumn("ids", F.lit(2))
    found = {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.encode(df, bpe.public_vocabulary()).collect()}
    for i, t in enumerate(texts):
        want = coders[1].encode(t or "", add_special_tokens=False).ids
        assert found[i] == (struct.pack(f"<{len(want)}I", *want), coders[1].decode(want, skip_special_tokens=False))
    assert bpe.encode(df.limit(0), bpe.public_vocabulary()).count() == 0


def test_bpe_decodes_the_ids_column(spark, coders, monkeypatch):
    want = [coders[0].ids(t) for t in ("Hello world", "", words(50, 2))]
    df = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate([*want, struct.pack("<2I", 5, 1 << 30)])] + [(9, None)], "n int, packed binary")
    found = {r.n: (r.packed, r.decoded) for r in bpe.decode(df, bpe.public_vocabulary(), keep=("n",), ids="packed").collect()}
    assert [found[i] for i in range(3)] == [(v, coders[0].decode(struct.unpack(f"<{len(v) // 4}I", v))) for v in want]
    assert found[3][1] == coders[0].tokens[5] and found[9] == (None, "")
    # a fault in the ids shows in what is decoded
    monkeypatch.setattr(bpe, "_encoded", lambda path: lambda batches: (b.set_column(1, "ids", [struct.pack("<I", 5)] * b.num_rows) for b in batches))
    assert bpe.encode(spark.createDataFrame([(1, "Hello")], "doc_id int, text string"), bpe.public_vocabulary()).first().decoded == coders[0].tokens[5]


# -- media


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=1000), st.sampled_from([1, 3, 64]))
def test_png_round_trip(data, width):
    payload = media.pad(data, width)
    assert media.decode_png(media.encode_png(payload, width)).tobytes() == payload and len(payload) % width == 0 and payload


def test_png_filters():
    """All five filters, mixed, against the definition."""
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, (25, 7)).astype(np.uint8)
    for kinds in (rng.integers(0, 5, 25), rng.integers(0, 3, 25), np.full(25, 2), np.full(25, 4)):
        lines = []
        for y, kind in enumerate(kinds):
            up = samples[y - 1].astype(int) if y else np.zeros(7, int)
            row = samples[y].astype(int)
            left, corner = np.append(0, row[:-1]), np.append(0, up[:-1])
            p = left + up - corner
            d = np.abs(np.stack([p - left, p - up, p - corner]))
            paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
            lines.append(bytes([kind]) + ((row - [0, left, up, (left + up) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes())
        png = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 25, 8, 0, 0, 0, 0)) + media._chunk(b"tEXt", b"note") + media._chunk(b"IDAT", zlib.compress(b"".join(lines))) + media._chunk(b"IEND", b"")
        assert (media.decode_png(png) == samples).all()


def test_png_damage():
    good = media.encode_png(media.pad(b"some payload" * 50))
    for i in range(0, len(good), 3):
        bad = bytearray(good)
        bad[i] ^= 1
        with pytest.raises(media.MediaError):
            media.decode_png(bytes(bad))
    for cut in (0, 7, 20, len(good) - 1):
        with pytest.raises(media.MediaError):
            media.decode_png(good[:cut])
    assert media.features(good[:-1])[-1] and media.features(good)[-1] is None


def test_media_operator(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "same"), (4, "same"), (5, "é" * 40000)], "doc_id int, text string").withColumn("key", F.lit(9)).withColumn("media", F.lit(8))
    stored = media.store(df)
    found = {r.doc_id: r for r in media.read(stored).collect()}
    assert found[1].payload_bytes == found[2].payload_bytes == 64 and found[1].n_bytes == 0 and found[5].payload_bytes == found[5].n_bytes == 80000
    assert found[3][1:] == found[4][1:] and len(found[3].phash) == 8 and found[1].tail_crc32 == zlib.crc32(bytes(64))
    broken = stored.withColumn("media", F.when(F.col("doc_id") == 3, F.expr("substring(media, 1, 30)")).when(F.col("doc_id") == 4, F.lit(None)).otherwise(F.col("media")))
    found = {r.doc_id: r for r in media.read(broken).collect()}
    assert found[3].error and found[3].phash is None and found[4].error is None and found[4].media_bytes is None
    assert media.read(media.store(df.limit(0))).count() == 0


def test_cosine_hash_ignores_small_changes():
    rng = np.random.default_rng(2)
    image = np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8)))
    a, b = (media.cosine_hash((image + noise).clip(0, 255).astype(np.uint8)) for noise in (0, rng.integers(-2, 3, image.shape)))
    assert (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() <= 12


# -- languages


def toy_model(spark, **more):
    text = {"en": "the of and to in is that it was for the house and the water of this world", "de": "der die und das ist nicht ein zu den von haus wasser und der welt schön", "ru": "это и не на что дом вода мир он она было этот для как"}
    df = spark.createDataFrame([(k, f"{v} {i}") for k, v in text.items() for i in range(20)] + [(None, "x"), ("en", None)], "lang string, text string")
    return langid.fit(df, **more)


def test_language_spans(spark):
    m = toy_model(spark)
    assert m.langs == ["de", "en", "ru"]
    mixed = "the water of the house and this world was for it, и это дом вода мир было как, der die und das ist nicht ein haus wasser zu den von der welt"
    (lang, score, spans), = langid.label([mixed], m, spans=True)
    assert [s[2] for s in spans] == ["en", "ru", "de"] and 0 < score < 1
    assert mixed[spans[1][0] : spans[1][1]].startswith("и это") and mixed[spans[2][0] :].startswith("der")
    found = langid.label([None, "", "123 !?", "Это дом", "日本語", "İstanbul the of and"], m)
    assert found[:3] == [("und", 0.0)] * 3 and found[3][0] == "ru" and found[4][0] in m.langs and found[4][1] == 0.0 and found[5][0] == "en"


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 7):
        scores = rng.normal(0, 3, (n, 3))
        found = langid.viterbi(scores, np.array([0, n]), 2.0)
        import itertools

        value = lambda path: sum(scores[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
        assert value(found.tolist()) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=n)))
    many = rng.normal(0, 3, (40, 3))
    bounds = np.array([0, 0, 5, 5, 30, 40])
    assert (langid.viterbi(many, bounds) == np.concatenate([langid.viterbi(many[a:b], np.array([0, b - a])) for a, b in zip(bounds, bounds[1:])])).all()


def test_language_operator(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    m = langid.fit(docs.where(~held))
    found = {r.doc_id: r for r in langid.predict(docs.withColumn("lang_pred", F.lit("clash")), m, spans=True).collect()}
    truth = {r.doc_id: r.lang for r in docs.where(held).select("doc_id", "lang").collect()}
    assert np.mean([found[i].lang_pred == lang for i, lang in truth.items()]) > 0.97 and all(0 <= r.score <= 1 for r in found.values())
    assert langid.predict(docs.limit(0), m).count() == 0
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs.limit(3), nothing).collect()} == {"und"}


def test_language_fit_is_bounded(spark):
    docs = spark.createDataFrame([("en", f"the house {i}") for i in range(300)] + [("de", "das haus")], "lang string, text string")
    m = langid.fit(docs, per_lang=50)
    assert m.langs == ["de", "en"] and langid.label(["the house"], m)[0][0] == "en"


def test_two_hundred_languages(spark, monkeypatch):
    """All are learned, whatever their number."""
    name = lambda i: f"l{i:03d}"
    data = [(name(i), words(8, 9000 + i)) for i in range(200)] + [(name(0), words(5, 9000))] * 30
    monkeypatch.setattr(langid, "LANGS", 7)
    m = langid.fit(spark.createDataFrame(data, "lang string, text string"))
    assert m.langs == [name(i) for i in range(200)]
    assert np.mean([langid.label([t], m)[0][0] == lang for lang, t in data[:200]]) > 0.9


def test_marks_are_no_letters(spark):
    m = toy_model(spark)
    assert langid.label(["\u0301\u0301", "\u0301 12", "e\u0301"], m)[:2] == [("und", 0.0)] * 2 and langid.label(["the\u0301 house"], m)[0][0] == "en"


def test_language_of_long_texts(spark, monkeypatch):
    m = toy_model(spark)
    text = "the water of the house and this world was for it " * 40 + "der die und das ist nicht ein haus wasser zu den von der welt " * 30
    (lang, score, spans), = langid.label([text], m, spans=True)
    monkeypatch.setattr(langid, "LONG", 200)
    (again, about, parts), = langid.label([text], m, spans=True)
    assert lang == again and abs(score - about) < 0.02 and [s[2] for s in parts] == [s[2] for s in spans] and parts[-1][1] == spans[-1][1]


def test_language_of_long_texts_beside_texts_without_words(spark):
    m = toy_model(spark)
    gap = " " * (langid.LONG + 1)
    texts = ["the water" + gap + "the house", gap, None, "12", "das haus" + gap, "the house"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r[0]: (r[1], r[2]) for r in langid.predict(docs, m).collect()}
    assert found == {0: ("en", 1.0), 1: ("und", 0.0), 2: ("und", 0.0), 3: ("und", 0.0), 4: ("de", 1.0), 5: ("en", 1.0)}
    for t in texts:
        assert langid.label([t], m) == langid.label([None, "12", t], m)[2:]
    nothing = langid.Model([], np.zeros((langid.BUCKETS, 0), np.float32), np.zeros((256, 0), bool), 0)
    assert langid.label([texts[0]], nothing) == [("und", 0.0)]


def test_language_fit_draws_different_texts(spark):
    data = [("en", "the house")] * 600 + [("en", f"cold water {i}") for i in range(300)] + [("de", "das haus")] * 300
    m = langid.fit(spark.createDataFrame(data, "lang string, text string"), per_lang=50)
    once = langid.fit(spark.createDataFrame([*dict.fromkeys(data)], "lang string, text string"), per_lang=50)
    assert m.langs == ["de", "en"] and langid.label(["das haus"], m)[0][0] == "de"
    assert (m.scores == once.scores).all() and m.candidates[:, 0].any()
    fewest = langid.fit(spark.createDataFrame(data, "lang string, text string"), per_lang=0)
    assert fewest.candidates.any(axis=0).all()


# -- sharding


def test_lookup_table():
    shards = [f"s{i}" for i in range(7)]
    table = sharding.fill(shards, 101)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    # turn by turn, from the definition
    lists = []
    for s in shards:
        offset, skip = sharding._number(f"offset:{s}") % 101, sharding._number(f"skip:{s}") % 100 + 1
        lists.append([(offset + j * skip) % 101 for j in range(101)])
    slow = [None] * 101
    while None in slow:
        for i, order in enumerate(lists):
            if None in slow:
                slow[next(x for x in order if slow[x] is None)] = i
    assert table == slow
    a, b = sharding.fill([f"s{i}" for i in range(20)], 10007), sharding.fill([f"s{i}" for i in range(19)], 10007)
    assert sum(x != y for x, y in zip(a, b) if x != 19) < 0.06 * 10007  # few move when a shard goes
    for bad in ([], ["x"] * 200):
        with pytest.raises(ValueError):
            sharding.fill(bad, 101)


def test_placement(spark):
    import hashlib

    shards = ["a", "b", "c"]
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,), (7,)], "doc_id bigint").withColumn("slot", F.lit("clash"))
    found = sharding.place(df, shards)
    owner = sharding.fill(shards)
    for doc_id, slot, shard in rows(found):
        key = "" if doc_id is None else str(doc_id)
        assert slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE and shard == shards[owner[slot]]
    assert found.count() == 52 and sharding.place(df.limit(0), shards).count() == 0
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


# -- WARC


def pages(spark):
    big = "<p>" + "é" * 700
    data = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "x y\r\nz", "tiny"), (5, "u", "tiny"), (6, "u", None), (7, "u", ""), (None, "n", big), (8, "w", "WARC/1.1\r\n\r\n" + words(400, 1)), (8, "w", "WARC/1.1\r\n\r\n" + words(400, 1))]
    return spark.createDataFrame(data, "page_id bigint, url string, html string").withColumn("content", F.lit("clash"))


def test_warc_round_trip(spark):
    archives = warc.write(pages(spark))
    found = Counter((r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in warc.read(archives).collect())
    assert found == {(1, "revisit", 1403, 3): 1, (2, "revisit", 1403, 3): 1, (3, "response", 1403, None): 1, (None, "revisit", 1403, 3): 1, (4, "response", 4, None): 1, (5, "response", 4, None): 1, (6, "response", 0, None): 1, (7, "response", 0, None): 1, (8, "response", len("WARC/1.1\r\n\r\n" + words(400, 1)), None): 2}
    texts = {r.page_id: r.payload for r in warc.read(archives, payload=True).collect()}
    assert texts[4] == b"tiny" and texts[1] is None and texts[8].startswith(b"WARC/1.1")
    assert warc.gaps(archives, F.lit("a")).count() == 0
    assert warc.read(warc.write(pages(spark).limit(0))).count() == 0


def archive(n, packed=True):
    import hashlib

    out = []
    for i in range(n):
        body = f"payload {i} ".encode() * (i + 1)
        r = warc.record(i, f"http://h/{i}", body, hashlib.sha1(body).digest(), None)
        out.append(warc.member(r) if packed else r)
    return out


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(spark, packed):
    parts = archive(8, packed)
    starts = np.cumsum([0] + [len(p) for p in parts])
    assert [p[0] for p in warc.salvage(b"".join(parts))[0]] == list(range(8)) and warc.salvage(b"".join(parts))[1] == []
    for hurt in (2, 0, 7):
        bad = [bytearray(p) for p in parts]
        bad[hurt][len(bad[hurt]) - 12] ^= 0xFF
        found, gaps = warc.salvage(b"".join(bytes(b) for b in bad))
        assert [p[0] for p in found] == [i for i in range(8) if i != hurt]
        assert [(a, b) for a, b, _ in gaps] == [(starts[hurt], starts[hurt + 1])] and gaps[0][2]
    found, gaps = warc.salvage(b"junk" * 9 + parts[0] + b"\0" * 50 + parts[1] + parts[2][:-9])
    assert [p[0] for p in found] == [0, 1] and len(gaps) == 3 and gaps[0][:2] == (0, 36)
    whole = b"".join(parts)
    assert warc.salvage(b"") == ([], []) and warc.salvage(whole[5 : starts[2]])[0][-1][0] == 1
    df = spark.createDataFrame([("f", bytearray(b"xx" + parts[3])), ("g", None)], "path string, content binary")
    assert rows(warc.gaps(df)) and [r.page_id for r in warc.read(df).collect()] == [3]
    with pytest.raises(Exception, match="of an archive"):
        warc.read(df, strict=True).collect()


def test_records_without_digests(spark):
    body = b"HTTP/1.1 200 OK\r\n\r\n<p>hi"
    plain = lambda kind, block, more=b"": b"WARC/1.1\r\nWARC-Type: %s\r\nX-Page-ID: 7\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, more, len(block), block)
    found, gaps = warc.salvage(plain(b"response", body) + plain(b"response", body, b"WARC-Payload-Digest: sha1:AAAA\r\n") + plain(b"revisit", b""))
    assert [(p[0], p[2], p[3]) for p in found] == [(7, "response", 5), (7, "revisit", 0)] and [g[2] for g in gaps] == ["payload digest differs"]


def test_salvage_inside_members():
    plain = archive(5, packed=False)
    bad = bytearray(plain[2])
    bad[-12] ^= 0xFF
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    several = warc.member(b"".join([info, *plain[:2], bytes(bad), *plain[3:]]))
    found, gaps = warc.salvage(several + warc.member(info) + warc.member(plain[2]))
    assert [p[0] for p in found] == [0, 1, 3, 4, 2] and [(a, b) for a, b, _ in gaps] == [(0, len(several))]
    assert [p[0] for p in warc.salvage(info + plain[0] + info + plain[1])[0]] == [0, 1] and not warc.salvage(info + plain[0] + info)[1]
    for level in (0, 6):
        cut = warc.member(b"".join([*plain[:4], random.Random(5).randbytes(900), plain[4]]), level)[:-300]
        found, gaps = warc.salvage(b"xx" + cut)
        assert [p[0] for p in found] == [0, 1, 2, 3] and len(gaps) == 2 and gaps[1][1:] == (len(cut) + 2, "cut member")


# -- URLs


def test_url_rules_of_many_lengths(spark):
    rules = [("com", "/" + "a" * i, "block" if i == 4150 else "allow") for i in range(4200)]
    df = spark.createDataFrame([(1, "http://x.com/" + "a" * 4150)], "page_id bigint, url string")
    found = url_filter.judge(df, url_filter.rule_table(spark, rules)).first()
    assert found.verdict == "block" and len(found.rule) == 4154


def test_url_rules_beyond_any_number_of_lengths(spark, monkeypatch):
    """5,000 path lengths; once as a table that is broadcast, once as one that is not."""
    rules = [("com", "/" + "a" * i, "block" if i % 2 else "allow") for i in range(5000)] + [("b.net", "/", "block")]
    df = spark.createDataFrame([(i, f"http://x.com/{'a' * i}") for i in (4203, 4100, 3, 4998)] + [(9, "http://b.net/x"), (8, "http://net/x")], "page_id bigint, url string")
    for most in (url_filter.BROADCAST_RULES, 10):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
        found = {r.page_id: (r.verdict, len(r.rule or "")) for r in url_filter.judge(df, url_filter.rule_table(spark, rules)).collect()}
        assert found == {4203: ("block", 4207), 4100: ("allow", 4104), 3: ("block", 7), 4998: ("allow", 5002), 9: ("block", 6), 8: ("allow", 0)}


def test_hosts_of_many_labels(spark):
    host = "a." * 10_000 + "example.com"
    df = spark.createDataFrame([(1, f"http://{host}/en/x"), (2, "http://" + "." * 9_999 + "/")], "page_id bigint, url string")
    found = {r.page_id: (r.rule, r.host) for r in url_filter.judge(df, url_filter.rule_table(spark, url_filter.RULES)).collect()}
    assert found == {1: ("example.com/en/", host), 2: (None, "." * 9_999)}


def test_url_rules(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en", "block"), ("example.com", "/en/x", "allow"), ("www.example.com", "/", "block"), ("net", "", "block"), ("net", "", "allow")]
    hosts = ["com", "example.com", "EXAMPLE.com", "www.example.com", "a.b.www.example.com", "notexample.com", "x.net", "net", "example.org", "", "com.", "é.com", "example.com:80"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en", "/english?x=/en/", "/en/x/y#f", "?q", "#f", "/EN")] + [None, "no scheme", "://", "a://b://c.com/en", "http://x.net/\n/en"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[3]), (3, urls[3])], "page_id bigint, url string").withColumn("rule", F.lit("clash"))
    found = rows(url_filter.judge(df, url_filter.rule_table(spark, rules)))
    assert len(found) == len(urls) + 2

    def judged(url):
        after = url.split("://", 1)[1] if url and "://" in url else ""
        m = re.match(r"([^/?#]*)([^?#]*)", after)
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1])
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and m[2].startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        return host, m[2], best[2], best[3]

    for page, *got in found:
        assert tuple(got) == judged(urls[3 if page is None else page])
    assert url_filter.judge(df.limit(0), url_filter.rule_table(spark, rules)).count() == 0
    assert {r.verdict for r in url_filter.judge(df, url_filter.rule_table(spark, rules).limit(0)).collect()} == {"allow"}


# -- nearest neighbours


def exact(vectors, query, k):
    d = {i: float(np.sqrt(((np.array(v, float) - np.array(vectors[query], float)) ** 2).sum())) for i, v in vectors.items() if i != query}
    return sorted(d.items(), key=lambda x: (x[1], x[0]))[:k]


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(12, 16))
    vectors = {i: [float(x) for x in np.float32(centre[i % 12] + 0.3 * rng.normal(size=16))] for i in range(900)}
    for i in range(900, 1200):
        vectors[i] = vectors[5]  # a very common vector
    data = [(i, v) for i, v in vectors.items()] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, 2.0]), (2004, [None] + [1.0] * 15), (2005, [float("inf")] * 16), (None, vectors[0]), (7, vectors[7])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").withColumn("rep", F.lit("clash")).withColumn("ids", F.lit(1)).repartition(3)
    found = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = [i for i in vectors if i % 50 == 0]
    assert sorted(found) == queries
    hits = 0
    for q in queries:
        got = sorted(found[q])
        want = exact(vectors, q, 10)
        assert [g[0] for g in got] == list(range(1, 11)) and q not in [g[1] for g in got]
        assert all(s == pytest.approx(dict(exact(vectors, q, 2000))[v], abs=1e-12) for _, v, s in got)
        assert [(g[2], g[1]) for g in got] == sorted((g[2], g[1]) for g in got)
        hits += len({g[1] for g in got} & {v for v, _ in want})
    assert hits >= 0.95 * 10 * len(queries)
    assert [g[1] for g in sorted(found[900])] == [5, *range(901, 910)]  # ties: smaller ids


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id") == 0).collect()) == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0 and ann.search(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_parts_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 16)
    rng = np.random.default_rng(1)
    vectors = {i: [float(x) for x in rng.normal(size=4)] for i in range(200)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>")
    got = [r.vec_id for r in ann.search(df, F.col("vec_id") == 0).sort("rank").collect()]
    assert got == [v for v, _ in exact(vectors, 0, 10)]


def test_repeated_ids_have_their_least_vector(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0, 1.0]), (1, [2.0, 9.0]), (1, [2.0, 8.0]), (2, [5.0, 0.0])], "vec_id bigint, embedding array<double>")
    for parts in (1, 3):
        assert sorted((r.vec_id, r.score) for r in ann.search(df.repartition(parts), F.col("vec_id") == 0).collect()) == [(1, pytest.approx(65**0.5)), (2, 4.0)]


def test_recall_on_vectors_that_point_anywhere(spark):
    """The hardest kind, at the registered query's parameters."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 64))
    x = np.float32(x / np.linalg.norm(x, axis=1)[:, None])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    far = ann._distances(x[::100].astype(float), x.astype(float))
    far[np.arange(60), np.arange(0, 6000, 100)] = np.inf
    assert np.mean([len(found[100 * i] & {*w}) / 10 for i, w in enumerate(np.argsort(far, axis=1)[:, :10].tolist())]) > 0.95


def test_wide_vectors_bound_the_sample(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE_BYTES", 8 * 64 * 50)
    rng = np.random.default_rng(12)
    vectors = {i: rng.normal(size=64).tolist() for i in range(500)}
    got = ann.search(spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>"), F.col("vec_id") == 3).sort("rank").collect()
    assert len(got) == 10 and len({r.vec_id for r in got} & {v for v, _ in exact(vectors, 3, 10)}) >= 8


def test_balanced_lists():
    points = np.random.default_rng(2).normal(size=(1000, 8))
    centroids = ann.bisected(points, 8)
    index = ann.Index.over(centroids)
    homes = Counter(h[0] for h in index.homes(points))
    assert len(centroids) == 8 and max(homes.values()) < 3 * 125
    nearest = np.argmin(ann._distances(points, centroids), axis=1)
    assert np.mean(index.walk(points)[0][:, 0] == nearest) > 0.99


def test_probing_ends_by_the_ratio(monkeypatch):
    monkeypatch.setattr(ann, "PRUNE", 1.45)  # as these lists of ten need it to reach beyond a walk
    rng = np.random.default_rng(3)
    points = rng.normal(size=(4000, 64))
    points /= np.linalg.norm(points, axis=1)[:, None]
    index = ann.Index.over(ann.bisected(points, 400))
    far = ann._distances(points[:20], index.centroids)
    near = far <= ann.PRUNE * far.min(axis=1)[:, None]
    assert near.sum(axis=1).min() > ann.BREADTH
    for got, want in zip(index.probes(points[:20], np.full(400, 10), 400), near, strict=True):
        assert set(np.flatnonzero(want)) <= {*got}


def test_neighbours_in_turns(spark, monkeypatch):
    monkeypatch.setattr(ann, "TURN", 7)
    monkeypatch.setattr(ann, "PART", 16)
    rng = np.random.default_rng(4)
    vectors = {i: [float(x) for x in rng.normal(size=4)] for i in range(200)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 10 == 0).sort("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(q, v) for q in range(0, 200, 10) for v, _ in exact(vectors, q, 10)]

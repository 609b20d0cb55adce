"""Packing, search, substrings, shards, near-duplicates and the pipeline: against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from compare import difference, duck
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from sliceworks.llm import packing, queries, sharding, simhash, substrings, topk
from sliceworks.llm.byte_bpe import RunEncoder

TOKENS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SMALL), duck(SMALL), queries.ORACLES[name]) == ""


@pytest.mark.parametrize("seed", range(20))
def test_best_cuts_are_best(seed):
    dice = random.Random(seed)
    length = 16
    places = np.cumsum([dice.randrange(1, length + 1) for _ in range(dice.randrange(1, 40))]).tolist()
    penalties = [dice.choice([0.0, 2.0, 7.0]) for _ in places]

    def cost(cuts):
        sizes = np.diff([0, *cuts])
        assert (sizes > 0).all() and (sizes <= length).all()
        return sum(length - sizes) + sum(penalties[places.index(c)] for c in cuts)

    best = {0: 0.0}
    for p, extra in zip(places, penalties, strict=True):
        best[p] = min(best[q] + length - (p - q) for q in best if p - q <= length) + extra
    assert cost(packing.best_cuts(places, penalties, length)) == best[places[-1]]
    open_end = packing.best_cuts(places, penalties, length, True)
    assert places[-1] - (open_end[-1] if open_end else 0) <= length
    assert (cost(open_end) if open_end else 0.0) == min(
        c for q, c in best.items() if places[-1] - q <= length)


def test_every_sentence_end_is_a_place_to_cut():
    ends = np.array([False, True])
    ids = np.zeros(501, dtype=int)
    ids[[9, 12, 13, 99, 199]] = 1
    places, penalties = packing.boundaries(ids, ends, 32, 2.0, 6.0)
    assert places[penalties == 2.0].tolist() == [10, 13, 14, 100, 200]
    assert places[-1] == 501 and penalties[-1] == 0.0 and np.diff(places, prepend=0).max() <= 32
    ids[499] = 1  # before the end token, which stays with the sentence
    places, penalties = packing.boundaries(ids, ends, 32, 2.0, 6.0)
    assert places[penalties == 2.0].tolist() == [10, 13, 14, 100, 200] and places[-1] == 501


def check_pieces(pieces, texts, length=4096):
    """Every id of every document lies in one piece, windows are full and gapless."""

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENS)
    ids = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,) for t in texts)
    windows, documents = brute.by_key([(p.sequence_id, p.offset, len(p.ids)) for p in pieces]), []
    for rows in windows.values():
        at = 0
        for _, offset, size in sorted(rows):
            assert offset == at and size > 0
            at += size
        assert at <= length
    at = []
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.start == len(at) and p.length == len(p.ids)
        at += p.ids
        if len(at) == p.doc_tokens:
            documents.append(tuple(at))
            at = []
    assert sorted(documents) == ids and not at
    total = [sum(size for _, _, size in rows) for rows in windows.values()]
    padding = sum(length - n for n in total if n & (n - 1))
    assert padding < 0.01 * sum(total)


@pytest.mark.parametrize("seed", range(3))
def test_word_runs_cut_where_the_tokenizer_does(seed):
    from tokenizers import Tokenizer

    plain, dice = Tokenizer.from_file(TOKENS), random.Random(seed)
    with open(TOKENS, encoding="utf-8") as file:
        encoder = RunEncoder(file.read(), packing.word_runs(), True)
    signs = list(" \n\t\r\x0b\x1c\x1f\x85\xa0\u3000\u2003 abAB'sdtlvE19²ßÄöÅI\u0307\u030aΣ汉🙂.,!-_\\|<>") + [
        "<|endoftext|>", "<|ENDOFTEXT|>", "the ", "Straße,", "ÉCOLE "]
    for _ in range(3000):
        text = "".join(dice.choice(signs) for _ in range(dice.randrange(1, 24)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode(
            text, add_special_tokens=False).ids, text


def test_packing(spark, documents, nothing):
    pieces = packing.pack(documents, TOKENS, key="id", stretch=4).collect()
    check_pieces(pieces, [r.text for r in documents.collect()])
    assert packing.pack(nothing, TOKENS, key="id").count() == 0


def test_packing_query(spark):
    pieces = packing.pack(spark.read.parquet(f"{SMALL}/documents.parquet"), TOKENS).collect()
    crc = {(p.doc_id, p.start): zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in pieces}
    found = queries.QUERIES["op3_packing"](spark, SMALL).collect()
    assert {(p.doc_id, p.start): p.ids_crc32 for p in found} == crc


@pytest.mark.parametrize("width,values", [(3, 4), (8, 1000), (1, 2)])
def test_top_k(spark, monkeypatch, width, values):
    monkeypatch.setattr(topk, "BLOCK", 37)
    monkeypatch.setattr(topk, "ROUND", 3)
    dice = random.Random(width)
    rows = [(k, [dice.randrange(-values, values) / 1024 for _ in range(width)]) for k in range(1200)]
    rows += [(200, [0.0] * width), (200, [0.0] * width), (5000, [1.0] * width), (7, [2.0] * width)]
    odd = [(300, None), (301, [None] * width), (302, [float("nan")] * width), (400, [float("inf")] * width),
           (None, [1.0] * width), (303, []), (600, [1.0] * (width + 1)), (1, [0.5] * (width + 1))]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows + odd], "vec_id long, embedding array<double>, score int")
    whole = [(k, [int(np.floor(1024 * x)) for x in v]) for k, v in rows + odd[-2:]]
    found = topk.top_k(df.repartition(4), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, found)) == sorted(brute.top_k(whole))
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_of_large_numbers(spark):
    rows = [(k, [200_000.25 + k, -3.0, 150_000.5 - k]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(k, [int(np.floor(1024 * x)) for x in v]) for k, v in rows]
    found = topk.top_k(df, F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, found)) == sorted(brute.top_k(whole))


@pytest.mark.parametrize("seed", range(3))
def test_top_k_of_numbers_of_any_size(spark, monkeypatch, seed):
    """Vectors of small, large and huge components together, ranked by exact scores; ties by id."""

    monkeypatch.setattr(topk, "BLOCK", 40)
    dice = random.Random(seed)
    sizes = [1.0, 3e5, 1e12, 1e100, 1e300]
    rows = [(k, [dice.choice([-1, 0, 1, 0.5]) * dice.choice(sizes) for _ in range(4)]) for k in range(450)]
    rows += [(1000 + k, rows[k][1]) for k in range(20)] + [(2000, [1e307] * 4), (2100, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = [(k, [int(np.floor(1024 * x)) if abs(x) < 1e15 else int(1024 * x) for x in v]) for k, v in rows if k < 2000]
    most = 2 ** 63 - 1
    expected = [(q, r, i, max(-most, min(most, s))) for q, r, i, s in brute.top_k(whole)]
    found = topk.top_k(df, F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def check_unrepeated(df, found, key):
    expected = brute.unrepeated([(r[key], r.text) for r in df.collect()])
    rows = [(r[key], int(r.n_words), r.n_removed, r.kept) for r in found.collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(rows, key=order) == sorted(
        [(k, n, n - len(w), " ".join(w)) for k, n, w in expected], key=order)


@pytest.mark.parametrize("chars,suffixes", [(4_000_000, 1_000_000), (30_000, 3_000)])
def test_substrings(spark, documents, nothing, monkeypatch, chars, suffixes):
    monkeypatch.setattr(substrings, "BLOCK_CHARS", chars)
    monkeypatch.setattr(substrings, "ANCHOR_CHARS", 5 * chars)
    monkeypatch.setattr(substrings, "GROUP_SUFFIXES", suffixes)
    check_unrepeated(documents, substrings.remove_repeats(documents, key="id"), "id")
    assert substrings.remove_repeats(nothing, key="id").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_substrings_of_few_words(spark, monkeypatch, seed):
    monkeypatch.setattr(substrings, "BLOCK_CHARS", 800)
    monkeypatch.setattr(substrings, "GROUP_SUFFIXES", 20)
    dice = random.Random(seed)
    passages = [" ".join(dice.choice("ab" if seed % 2 else "abcdefgh") for _ in range(dice.randrange(5, 60)))
                for _ in range(12)]
    rows = [(k, " ".join(dice.choice(passages) for _ in range(dice.randrange(0, 4)))) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    check_unrepeated(df, substrings.remove_repeats(df, key="id"), "id")


@pytest.mark.parametrize("place", [9, 19])
def test_substrings_tell_windows_of_one_other_word_apart(spark, place):
    """Two words for which five-word sequences agree in 24 of 64 bits make no repeat."""

    line = [f"common{k}" for k in range(20)]
    begin, hashes = place // 5 * 5, substrings.WordHashes()
    seen = {}
    for k in range(100_000):
        five = [*line[begin:place], f"name{k}", *line[place + 1:begin + 5]]
        short = int(substrings.symbols(hashes.of(five))[0]) >> 40
        if short in seen:
            break
        seen[short] = k
    rows = [(n, " ".join([*line[:place], f"name{w}", *line[place + 1:]]))
            for n, w in enumerate([seen[short], k, seen[short]])]
    df = spark.createDataFrame(rows, "id long, text string")
    found = substrings.remove_repeats(df, key="id")
    assert {r.id: r.n_removed for r in found.collect()} == {0: 0, 1: 0, 2: 20}
    check_unrepeated(df, found, "id")


def test_sharding(spark, documents, nothing):
    rows = sharding.shard_documents(documents, key="id").collect()
    texts = sorted((r.id is not None, r.id or 0, len((r.text or "").encode()) + 16,
                    zlib.crc32((r.text or "").encode())) for r in documents.collect())
    assert sorted((r.id is not None, r.id or 0, r.size, r.text_crc32) for r in rows) == texts

    def draw(key, tree):
        while not isinstance(tree, int):
            weigh = lambda x: sum(map(weigh, x[1])) if isinstance(x[1], list) else x[1]
            named = lambda x, up: x[0] if isinstance(x[0], str) else f"{up}/{x[0]}"
            up, children = tree if isinstance(tree, tuple) else ("", tree)
            share = lambda n: (int(hashlib.md5(f"{key}/{n}".encode()).hexdigest()[:12], 16) + 1) / 2**48
            best = min(children, key=lambda c: -np.log(share(named(c, up))) / weigh(c))
            tree = best if isinstance(best[1], list) else best[0]
        return tree

    for r in rows:
        key = "null" if r.id is None else r.id
        assert r.shard == draw(key, sharding.even_tree(40)) and r.law == "key"
        assert r.grown_shard == draw(key, sharding.even_tree(40, 1))
        assert r.grown_shard in (r.shard, 40)
    for shard, own in brute.by_key([(r.shard, r.slot) for r in rows]).items():
        assert sorted(s for _, s in own) == list(range(len(own))), shard
    assert sharding.shard_documents(nothing, key="id").count() == 0


def test_shards_are_even_and_few_move(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard_documents(df)
    counts = [r["count"] for r in rows.groupBy("shard").count().collect()]
    assert len(counts) == 40 and 850 < min(counts) and max(counts) < 1150
    assert 800 < rows.filter("grown_shard = 40").count() < 1150
    slots = rows.groupBy("shard").agg(F.countDistinct("slot").alias("n"), F.max("slot").alias("m"),
                                      F.min("slot").alias("l")).collect()
    assert all(r.n == r.m + 1 and r.l == 0 for r in slots)


@pytest.mark.parametrize("radius", [0, 1, 3, 7])
def test_bit_slices(radius):
    dice = random.Random(radius)
    values = [dice.getrandbits(64) for _ in range(130)]
    values += [values[k] ^ sum(1 << b for b in dice.sample(range(64), dice.randrange(9))) for k in range(130)]
    planes = simhash.BitSlices(np.array(values, dtype=np.uint64))
    for v in values[:40]:
        near = [k for k, w in enumerate(values) if (v ^ w).bit_count() <= radius]
        assert planes.within(v, radius).tolist() == near


def test_near_duplicates(spark, documents, nothing):
    rows = simhash.near_duplicates(documents, key="id").collect()
    prints = {r.id: brute.fingerprint(r.text) for r in documents.collect()}
    own = [(r.id, r.text) for r in documents.collect()]
    values = [brute.fingerprint(t) for _, t in own]
    lowest = {}
    for (k, _), c in zip(own, brute.classes(values), strict=True):
        if k is not None:
            lowest[c] = min(k, lowest.get(c, k))
    expected = [(k, f"{v:016x}", lowest.get(c)) for (k, _), v, c in
                zip(own, values, brute.classes(values), strict=True)]
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, rows), key=order) == sorted(expected, key=order) and prints
    assert simhash.near_duplicates(nothing, key="id").count() == 0


def test_links_in_dense_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    dice = random.Random(1)
    values = set()
    for _ in range(6):
        centre = dice.getrandbits(64)
        for _ in range(40):
            values.add(centre)
            centre ^= sum(1 << b for b in dice.sample(range(64), dice.randrange(1, 5)))
    values = sorted(values)
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "f long").repartition(3)
    roots = {r.v: r.root for r in simhash.components(simhash.links(df)).collect()}
    found = [roots.get(simhash.signed(v), simhash.signed(v)) for v in values]
    plain = brute.classes(values)
    assert len(set(zip(found, plain, strict=True))) == len(set(plain)) == len(set(found))


def test_pipeline_keeps_one_document_of_each_component(spark):
    """Null ids of unrelated texts stay apart, and so do the texts of a repeated id."""

    dice = random.Random(3)
    texts = [" ".join(f"w{dice.randrange(10_000)}" for _ in range(60)) for _ in range(6)]
    a, b, c, d, e, f = texts
    rows = [(None, a, "x"), (None, b, "x"), (None, b, "x"), (None, b, "y"),  # of null ids only
            (7, c, "x"), (7, d, "x"), (7, d, "x"), (5, d, "x"),  # one id, two texts, one of them a copy
            (9, e, "x"), (None, e, "x"), (8, f, "x"), (8, f, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = [tuple(r) for r in corpus_pipeline.distinct_documents(spark, df, SMALL).collect()]
    assert sorted((r[:2] for r in found), key=str) == sorted(
        [(None, a), (None, b), (7, c), (5, d), (9, e), (8, f)], key=str)
    assert set(found) <= set(rows)
    assert corpus_pipeline.distinct_documents(spark, df.limit(0), SMALL).count() == 0


def test_pipeline(spark):
    """Each stage against the plain version, on what the stage before it left."""

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SMALL)
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(after, docs.schema)
        kept = {r.doc_id for r in after}
        if name in ("quality rules", "toxicity"):
            assert set(after) <= set(before) and 0 < len(after) < len(before) + (name == "toxicity")
        if name == "quality rules":
            for r in after:
                counts = brute.base_counts(r.text)
                assert counts[0] >= 50 and counts[4] <= 0.5 * counts[0]
        elif name == "simhash near-dedup":
            classes = brute.classes([brute.fingerprint(r.text) for r in before])
            assert kept == {min(r.doc_id for r, c in zip(before, classes, strict=True) if c == k)
                            for k in set(classes)} and set(after) <= set(before)
        elif name == "substring dedup":
            texts = {r.doc_id: r.text for r in before}
            left = {k: (n, w) for k, n, w in brute.unrepeated(texts.items())}
            for r in after:
                n, words = left[r.doc_id]
                assert r.text == (texts[r.doc_id] if n == len(words) else " ".join(words))
            assert len(after) == len(before)
        elif name == "packing":
            check_pieces(after, [r.text for r in before])
    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert {(p.doc_id, p.doc_tokens) for p in whole} == {(p.doc_id, p.doc_tokens) for p in after}

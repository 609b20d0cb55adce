"""Quality, language, toxicity, tokens, chat: against plain versions and on held-out rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F

from sliceworks.llm import byte_bpe, chat, language, queries, quality, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet").withColumnRenamed("doc_id", "id")


def test_quality_counts_and_verdict(spark, documents, nothing):
    model = quality.fit_quality(documents, labels(spark), key="id", buckets=1 << 12)
    rows = quality.quality_columns(documents, model).collect()
    assert len(rows) == documents.count() and rows[0].source == "s"

    good = {r.id for r in labels(spark).filter("quality = 1").collect()}
    buckets, shift, mask = 1 << 12, 64 - 12, (1 << 64) - 1

    def ngrams(text):
        h = [xxhash.xxh32_intdigest(w) for w in brute.WORDS(text or "")]
        pairs = [(a * 0x100000001B3 & mask) ^ b for a, b in zip(h, h[1:], strict=False)]
        mix = lambda x: (x * 0x9E3779B97F4A7C15 & mask) >> shift
        return [mix(x) for x in h], [mix(x) for x in pairs]

    raw, target = np.zeros((2, buckets)), np.zeros((2, buckets))
    for r in rows:
        for part, found in enumerate(ngrams(r.text)):
            for b in found:
                raw[part, b] += 1
                target[part, b] += r.id in good
    p = (raw + 1) / (raw.sum(1, keepdims=True) + buckets)
    q = (target + buckets * p) / (target.sum(1, keepdims=True) + buckets)
    weights = np.log(q / p)
    for r in rows:
        counts = brute.base_counts(r.text)
        assert (int(r.n_words), r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        one, two = ngrams(r.text)
        n = len(one) + len(two)
        score = (weights[0, one].sum() + weights[1, two].sum()) / n if n else 0.0
        assert math.isclose(score, r.quality_score, abs_tol=1e-9)
        assert r.kept == (not r.base_failed and r.quality_score >= model.threshold)
    assert quality.quality_columns(nothing, model).count() == 0
    empty = quality.fit_quality(nothing, labels(spark), key="id", buckets=16)
    assert not empty.weights.any() and empty.threshold == float("-inf")


@pytest.mark.parametrize("broadcast", [500_000, 10])
def test_quality_learns_from_all_labels(spark, monkeypatch, broadcast):
    """More labelled rows of either kind than any sample held: weights and threshold are those of all."""

    monkeypatch.setattr(quality, "LABELS", broadcast, raising=False)
    good, bad, half = {"aa": 20_000, "bb": 500}, {"cc": 20_000, "aa": 600}, 1 << 10
    words = [(w, y) for y, kind in ((1, good), (0, bad)) for w, n in kind.items() for _ in range(n)]
    docs = spark.createDataFrame([*((k, w) for k, (w, _) in enumerate(words)), (None, "aa"), (-1, "bb"), (-2, None)],
                                 "doc_id long, text string").repartition(4)
    given = spark.createDataFrame([*((k, y) for k, (_, y) in enumerate(words)), (None, 1), (-1, None), (0, 1), (-3, 1)],
                                  "doc_id long, quality int")
    model = quality.fit_quality(docs, given, buckets=half, min_words=1)
    ids = quality.WordIds()
    at = {w: int(ids.buckets(ids.of(w)[1], half)[0][0]) for w in ("aa", "bb", "cc")}
    raw, target = np.zeros(half), np.zeros(half)
    for w, n in {"aa": 20_601, "bb": 501, "cc": 20_000}.items():
        raw[at[w]] += n
        target[at[w]] += good.get(w, 0)
    p = (raw + 1) / (raw.sum() + half)
    weights = np.log((target + half * p) / (target.sum() + half) / p)
    assert np.allclose(model.weights[:half], weights, atol=1e-12) and not model.weights[half:].any()
    counts, edges = np.zeros((2, quality.BINS)), np.linspace(-quality.RANGE, quality.RANGE, quality.BINS + 1)
    for y, kind in ((1, good), (0, bad)):
        for w, n in kind.items():
            counts[y, int(np.floor((weights[at[w]] + quality.RANGE) * quality.BINS / (2 * quality.RANGE)))] += n
    assert model.threshold == quality.best_threshold(counts[1], counts[0], edges, 5.0)


def test_quality_threshold():
    edges = np.array([0.0, 1.0, 2.0, 3.0])
    assert quality.best_threshold(np.array([0, 0, 9]), np.array([9, 0, 0]), edges, 5) == 1.0
    assert quality.best_threshold(np.array([1, 0, 0]), np.array([0, 0, 0]), edges, 5) == float("-inf")


def test_quality_separates_labels(spark):
    rows = queries.QUERIES["op1_quality_rules"](spark, MEDIUM).join(
        spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").filter("n_words >= 50")
    share = {r.quality: r.kept for r in rows.groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.995 and share[0] < 0.05


def test_language_held_out(spark):
    rows = queries.QUERIES["op2_language_id"](spark, MEDIUM).join(
        spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    assert rows.filter("held_out").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    for r in rows.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1


def test_language_against_plain(spark, documents, nothing):
    train = spark.createDataFrame([("abab ab", "x"), ("cdcd", "y"), ("ab", "x"), (None, "x"), ("q", None)],
                                  "text string, lang string")
    model = language.fit_languages(train, sizes=(1, 2), buckets=1 << 10)
    assert model.languages == ["x", "y"]
    counts = np.zeros((1 << 10, 2))
    for text, lang in (("abab ab", 0), ("cdcd", 1), ("ab", 0)):
        for b in language.ngrams(text, (1, 2), 1 << 10):
            for k in b:
                counts[k, lang] += 1
    expected = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * 1024))
    assert np.allclose(model.matrix, expected, atol=1e-5)
    assert np.allclose(model.prior, np.log([3 / 5, 2 / 5]))
    found = {r.text: (r.lang_pred, r.score) for r in language.predict_languages(
        spark.createDataFrame([("AB",), ("cd",), ("12 3",), ("",), (None,)], "text string"), model).collect()}
    total = [model.prior[k] + sum(float(expected[b, k].sum())
                                  for b in language.ngrams("ab", (1, 2), 1 << 10)) for k in (0, 1)]
    assert found["AB"][0] == "x" and found["cd"][0] == "y"
    assert math.isclose(found["AB"][1], 1 / (1 + math.exp(total[1] - total[0])), rel_tol=1e-4)
    assert found["12 3"] == found[""] == found[None] == ("und", 0.0)
    assert language.predict_languages(documents, model).count() == documents.count()
    none = language.fit_languages(train.filter("lang = 'z'"))
    assert language.predict_languages(train, none).filter("lang_pred <> 'und'").count() == 0


def test_language_pieces(monkeypatch):
    whole = np.sort(np.concatenate(list(language.ngrams("some text of a few words", (1, 2, 3), 64))))
    monkeypatch.setattr(language, "PIECE", 5)
    parts = np.sort(np.concatenate(list(language.ngrams("some text of a few words", (1, 2, 3), 64))))
    assert (whole == parts).all()


def test_toxicity_held_out(spark):
    rows = queries.QUERIES["op10_toxicity"](spark, MEDIUM).join(
        spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, plain = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    wins = sum((a > b) + 0.5 * (a == b) for a in toxic for b in plain)
    assert wins / (len(toxic) * len(plain)) > 0.9
    hits = sum(r.predicted for r in rows if r.toxic)
    assert hits / len(toxic) > 0.6 and sum(r.predicted for r in rows if not r.toxic) < 0.02 * len(plain)


def test_toxicity_learns_rare_and_quoted_words(spark):
    """Words of one toxic text in a hundred, of which ordinary texts quote one each, and 400 of them."""

    dice = random.Random(5)
    plain = [f"plain{k * 7919 % 9973}" for k in range(600)]
    bad = ["".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(400)]
    text = lambda some: " ".join(dice.sample([*dice.sample(plain, 14), *some], 14 + len(some)))
    rows = [(k, text(dice.sample(bad, 4)), 1) for k in range(1800)]
    rows += [(2000 + k, text([bad[k]] if k < 400 else []), 0) for k in range(5400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.fit_toxicity(df, df)
    assert sum(b" " + w.encode() in model.toxic for w in bad) > 0.8 * len(bad)
    found = toxicity.score_toxicity(df, model).collect()
    assert np.mean([r.predicted for r in found if r.toxic]) > 0.8
    assert np.mean([r.predicted for r in found if not r.toxic]) < 0.1


def test_toxicity_odd_rows(spark, documents, nothing):
    known = labels(spark)
    model = toxicity.fit_toxicity(documents, known, key="id")
    rows = toxicity.score_toxicity(documents, model).collect()
    assert len(rows) == documents.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if not (r.text or "").split()}) == 1
    for some in (known.filter("toxic = 0"), known.filter("id < 0")):
        none = toxicity.fit_toxicity(documents, some, key="id")
        assert {r.score for r in toxicity.score_toxicity(documents, none).collect()} == {0.0}
    assert toxicity.score_toxicity(nothing, model).count() == 0


def test_windows():
    assert toxicity.windows(None) == toxicity.windows("") == [b""]
    assert [len(w.split()) for w in toxicity.windows("w " * 40)] == [16, 16, 8]
    assert b"".join(toxicity.windows("y" * 3000)) == b" " + b"y" * 3000


def plain_encoding():
    import tiktoken

    tokens = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks={t: k for k, t in enumerate(tokens)})


def test_byte_bpe_against_tiktoken(spark, documents, nothing):
    plain = plain_encoding()
    encoded = byte_bpe.encode_bytes(documents, RANKS, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode_bytes(encoded, RANKS).collect()
    assert len(decoded) == documents.count()
    for r in decoded:
        text = r.text or ""
        assert r.ids == plain.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
        assert list(r.ends) == list(np.cumsum([len(plain.decode_single_token_bytes(k)) for k in r.ids]))
        inside = sum((text.encode()[e:e + 1] or b"a")[0] & 0xC0 == 0x80 for e in r.ends)
        assert r.n_split == inside
    assert byte_bpe.encode_bytes(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_runs_cut_where_the_pattern_does(seed):
    import random

    plain, dice = plain_encoding(), random.Random(seed)
    encoder = byte_bpe.RunEncoder(byte_bpe.tokenizer_json(byte_bpe.read_ranks(RANKS),
                                                          public_tokenizers.PATTERN),
                                  byte_bpe.run_finder(), False)
    signs = " \n\t\r\x0b\x1c\x85\xa0　 abAB'sdtlve19²ⅷéñ汉🙂.,!-_\\|<>s​"
    for _ in range(3000):
        text = "".join(dice.choice(signs) for _ in range(dice.randrange(1, 24)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode_ordinary(text)


def test_characters_split_between_tokens():
    characters = byte_bpe.byte_characters()
    table = byte_bpe.decode_table(["".join(characters[b] for b in t) for t in byte_bpe.read_ranks(RANKS)])
    ids = plain_encoding().encode_ordinary("a🙂é汉")
    texts = byte_bpe.token_texts([table[k] for k in ids])
    assert "".join(texts) == "a🙂é汉" and "" in texts


def test_byte_bpe_query(spark):
    plain = plain_encoding()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.QUERIES["op7_byte_bpe"](spark, SMALL).collect():
        ids = plain.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a\\b </s>[INST]"), (1, 2, "user", "<<SYS>> <"), (1, 3, "assistant", ""),
    (2, 0, "assistant", "first"), (2, 1, "tool", "x <<TEXT>> y"), (2, 2, None, None), (2, 2, None, None),
    (3, 5, "system", "\\\\ <<</SYS>>"), (3, None, "user", "null turn"), (None, 0, "user", " no id "),
    (4, 0, "a<<TEXT>>b", "role [/INST] "), (4, 1, "user", " [/INST] </s"), (4, 2, "assistant", "s> <</s>")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn(
        "loss", F.lit("clash"))
    found = {r.conv_id: r for r in queries.read_back(chat.format_chat(df)).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    assert set(found) == {r[0] for r in CONVERSATIONS}
    for key, rows in brute.by_key(CONVERSATIONS).items():
        rows = sorted(rows, key=order)
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows)
        loss = "".join(t or "" for _, _, r, t in rows if r == "assistant")
        assert found[key].n_turns == len(rows)
        assert found[key].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (found[key].loss_chars, found[key].loss_sha256) == (
            len(loss), hashlib.sha256(loss.encode()).hexdigest())
    segments = chat.format_chat(df).collect()
    for r in segments:
        if r.part == "text":
            assert not any(c in r.segment for c in chat.Template().controls())
    valid = {r.conv_id: r.valid for r in sorted(segments, key=lambda r: r.position)}
    assert valid == {1: True, 2: False, 3: False, 4: False, None: True}
    assert queries.read_back(chat.format_chat(df.limit(0))).count() == 0

"""Embedding near-duplicates, conversation repair and source divergence against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest
from compare import difference
from conftest import SMALL
from pyspark.sql import GroupedData

from sliceworks.llm import divergence, embeddings, queries, repair


def test_hadamard_keeps_lengths_and_rows():
    x = np.random.RandomState(1).normal(size=(7, 16))
    turned = embeddings.hadamard(x)
    signs = np.array([[(-1) ** (a & b).bit_count() for a in range(16)] for b in range(16)])
    assert np.allclose(turned, x @ signs.T)
    assert (embeddings.hadamard(x[3:4]) == turned[3:4]).all()


@pytest.mark.parametrize("length,n", [(1, 10), (3, 1000), (64, 10_000), (100, 10 ** 7)])
def test_tables_have_enough_codes_and_no_probe_twice(length, n):
    plan = embeddings.plan_tables(length, n, 0.9, 1e-3)
    assert (2 * plan.width) ** (plan.hashes - 1) * 2 * plan.last >= 32 * n and plan.probes > 1
    x = embeddings.padded(np.random.RandomState(2).normal(size=(50, length)), plan.width)
    for table in range(min(3, plan.tables)):
        assert all(len(set(row)) == plan.probes for row in plan.codes(x, table).tolist())


def vectors(seed: int, length: int = 24) -> list[tuple]:
    """Ids with vectors: lone ones, chains of near ones, a large group, copies, and odd ones."""

    dice = np.random.RandomState(seed)
    near = lambda v, s: v + dice.normal(size=length) * s * np.linalg.norm(v) / length ** 0.5
    rows = [dice.normal(size=length) for _ in range(150)]
    for _ in range(25):
        v = dice.normal(size=length)
        for _ in range(dice.randint(2, 7)):
            rows.append(v)
            v = near(v, 0.4)
    middle = dice.normal(size=length)
    rows += [near(middle, 0.15) for _ in range(90)]
    rows += [rows[3]] * 40 + [rows[-1] * 3.0] * 5 + [rows[5] * 1e200, rows[5] * 1e-200]
    out = [(int(k), [float(x) for x in v]) for k, v in zip(dice.permutation(len(rows)), rows, strict=True)]
    tied, gone = out[7], float("nan")
    out += [(9000, None), (9001, []), (9002, [0.0] * length), (9003, [None] * length), (9004, [gone] * length),
            (9005, [float("inf")] * length), (None, tied[1]), (None, None), tied, (tied[0], rows[9].tolist()),
            (9006, tied[1][:5]), (9007, tied[1][:5]), (9008, [-0.0] * length)]
    return out


def plain_links(rows, threshold=0.9):
    """(id, links, component, kept) of every row."""

    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
              for _, v in rows]
    scaled = [np.array(v) / np.abs(v).max() if ok else None for (_, v), ok in zip(rows, usable, strict=True)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations([k for k, ok in enumerate(usable) if ok], 2):
        x, y = scaled[a], scaled[b]
        if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[find(k)] = min(least.get(find(k), key), key)
    return [(key, links[k], least.get(find(k)), key == least.get(find(k))) for k, (key, _) in enumerate(rows)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("seed,chunk", [(1, 1024), (2, 16), (3, 7)])
def test_near_vectors(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(embeddings, "CHUNK_MEMBERS", chunk)
    monkeypatch.setattr(embeddings, "ROWS", 5 if chunk == 7 else 512)
    rows = vectors(seed)
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows],
                               "id long, v array<double>, n_links int, kept string").repartition(5)
    found = embeddings.near_vectors(df, "id", "v", miss=1e-7)
    assert found.columns == ["id", "n_links", "component_id", "kept"]
    assert ordered(map(tuple, found.collect())) == ordered(plain_links(rows))


def test_near_vectors_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_vectors(df).count() == 0
    df = spark.createDataFrame([(3, None), (4, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embeddings.near_vectors(df).collect())) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_recall_at_the_threshold(spark):
    """Pairs just within the threshold, the hardest to find, at the default chance of a miss."""

    dice = np.random.RandomState(5)
    a, b = dice.normal(size=(2, 4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9001 * a + (1 - 0.9001 ** 2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([a, b]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: r.component_id for r in embeddings.near_vectors(df).collect()}
    assert sum(found[4000 + k] == k for k in range(4000)) >= 0.998 * 4000


# ---- repair


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of a conversation's rows
    (turn, role, text) in order: a search over all edit scripts by cost, then audit."""

    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                      else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    first = [r[1][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(first, first[1:], strict=False))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, roles, turns_now = heapq.heappop(heap)
        if (k, roles[-1:] if roles != "s" else "s") in done:
            continue
        done.add((k, roles[-1:] if roles != "s" else "s"))
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            text = "\n".join(f"{r}:{t}" for r, t in turns_now)
            return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest())
        following = {"": "su", "s": "u", "u": "a", "a": "u"}[roles[-1:]]
        whole = {"u": "user", "a": "assistant"}
        turn = following[-1]
        heapq.heappush(heap, (cost + 2, audit + "I", k, roles + turn, (*turns_now, (whole[turn], ""))))
        if k == len(rows):
            continue
        _, role, text = rows[k]
        heapq.heappush(heap, (cost + 3, audit + "D", k + 1, roles, turns_now))
        if faults[k] in ("blank", "duplicate"):
            continue
        more = faults[k] == "truncated"
        if role[:1] and role[0] in following:
            heapq.heappush(heap, (cost + more, audit + "K", k + 1, roles + role[0], (*turns_now, (role, text))))
        heapq.heappush(heap, (cost + 2 + more, audit + "R", k + 1, roles + turn, (*turns_now, (whole[turn], text))))


def conversations(seed: int) -> list[tuple]:
    dice = random.Random(seed)
    rows = []
    for conv in range(60):
        for turn in range(dice.randrange(0, 9)):
            role = dice.choice(["user", "assistant", "system", "user", "assistant", "tool", "usher", "", None])
            text = dice.choice(["Yes.", "No", "Why?", " ", "", None, "so  ", "ok.\n", "more", "Well! "])
            text = text if text is None or dice.random() < 0.5 else f"{turn}{text}"
            at = dice.choice([turn, turn, turn, 2 * turn, None])
            rows += [(conv if conv else None, at, role, text)] * dice.choice([1, 1, 1, 2, 4])
    rows += [(900, k, ["user", "assistant"][dice.randrange(2)], f"Turn {k // 2}.") for k in range(300)]
    rows += [(901, 5, "user", "the same")] * 200 + [(902, 1, "user", "a word " * 50_000), (902, 2, "assistant", ".")]
    return rows


def plain_conversations(rows):
    sort = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {key: plain_repair(sorted(((t, " " if r is None else r, " " if x is None else x) for _, t, r, x in own),
                                     key=sort)) for key, own in brute.by_key(rows).items()}


def one_text_per_turn(rows):
    """Rows whose order no hash of a text decides: of one turn and role, the copies of one text."""

    kept, out = {}, []
    for conv, turn, role, text in rows:
        text_of = kept.setdefault((conv, turn, role if role is not None else " "), text)
        out.append((conv, turn, role, text_of))
    return out


@pytest.mark.parametrize("seed,chunk", [(1, 4096), (2, 3), (3, 1), (4, 2)])
def test_repair(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    monkeypatch.setattr(repair, "TOGETHER", 50 if seed % 2 else 8192)
    rows = one_text_per_turn(conversations(seed))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "c long, t long, r string, x string, audit string, cost int").repartition(3)
    found = {r.c: tuple(r)[1:] for r in repair.repair(df, "c", "t", "r", "x").collect()}
    assert found == plain_conversations(rows)


def test_ways_of_least_cost_are_least_in_ascii():
    for n, seed in itertools.product(range(7), range(40)):
        dice = random.Random(100 * n + seed)
        rows = [(k, dice.choice(["user", "assistant", "system", "tool"]), dice.choice(["a.", "b", "", "c?"]))
                for k in range(n)]
        seen, coded = set(), []
        for _, role, text in rows:
            gone = not text or (role, text) in seen
            seen.add((role, text))
            coded.append((repair.INITIALS.index(role[0]) if role[0] in repair.KEPT else 3, gone,
                          not gone and text[-1] not in ".!?", 0))
        ranking = repair.Ranking([(coded, repair.FINAL, True)])
        (path,), _ = ranking.paths(0)
        expected = plain_repair(rows)
        assert (ranking.costs[0][0], "".join(x for _, x in path)) == expected[5:7], rows


def test_damage_is_whole_and_conversations_stay(spark):
    rows = [(k // 3, k % 3, ["user", "assistant", None][k % 3], "One. Two? three!") for k in range(300)]
    rows += [(None, 1, "user", "Hm."), (7, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = queries.repair.damage(df).collect()
    drawn = Counter()
    for (conv, turn, role, text), r in zip(rows, found, strict=True):
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        drawn[kind] += 1
        text = " " if text is None else text
        assert r.text == ("" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        assert r.role == ("user" if kind == 4 else " " if role is None else role)
        assert r.copies == {0: 0, 3: 2}.get(kind, 1)
    assert set(range(5)) <= set(drawn)
    lost = spark.createDataFrame([(1, 0, "user", "a.", 0), (2, 0, "user", "a.", 1)],
                                 "conv_id long, turn long, role string, text string, copies int")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(lost, copies="copies").collect()}
    assert got == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()), 2: plain_repair([(0, "user", "a.")])}
    assert repair.repair(lost.limit(0), copies="copies").count() == 0


# ---- divergence


def plain_divergence(rows, least, top):
    """(lang, source, part, item, value, rank) from (text, lang, source) rows, by plain counting."""

    terms = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    counts, documents, out = defaultdict(Counter), defaultdict(Counter), []
    for text, lang, source in ((t or "", a or "", b or "") for t, a, b in rows):
        found = terms(lower(text))
        counts[lang, source].update(found)
        documents[lang].update(set(found))
    order = lambda r: (-r[4], r[3].encode())
    for lang, source in counts:
        kept = [t for t, d in documents[lang].items() if d >= least]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        whole = sum(groups.values(), Counter())

        def price(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        own, q = price(groups[source]), price(whole)
        pairs = [(lang, source, "pair", s, sum(abs(own[t] - p) for t, p in price(c).items()))
                 for s, c in groups.items() if s != source]
        more = [(lang, source, "term", t, own[t] - q[t]) for t in kept if groups[source][t] and own[t] > q[t]]
        out += [(*r, k + 1) for k, r in enumerate(sorted(pairs, key=order))]
        out += [(*r, k + 1) for k, r in enumerate(sorted(more, key=order)[:top])]
    return out


@pytest.mark.parametrize("seed,terms,piece", [(1, 2048, 1 << 20), (2, 4, 7), (3, 1, 3)])
def test_divergence(spark, monkeypatch, seed, terms, piece):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", terms)
    monkeypatch.setattr(divergence, "PIECE", piece)
    monkeypatch.setattr(divergence, "GATHERED", 40 if seed > 1 else 10_000)
    monkeypatch.setattr(divergence, "LEAVES", 8 if seed == 3 else 1 << 19)
    dice = random.Random(seed)
    words = ["a", "B", "bb", "Éé", "éé", "ß", "汉字", "z'z", "q1q", "long" * 9, "🙂", "x-y"]
    text = lambda: " ".join(dice.choice(words) for _ in range(dice.randrange(0, 40)))
    rows = [(text(), dice.choice(["en", "fr", None, ""]), dice.choice(["s", "t", "u", None, "é"])) for _ in range(300)]
    rows += [(None, "de", "s"), ("", "de", "t"), ("one two", "de", None), ("a b " * 20_000, "en", "s"),
             *[("same row bb", "en", "t")] * 30, ("\x00a\x7fb\x1fc", "fr", "s")]
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows],
                               "text string, lang string, source string, item string, n int, d int").repartition(4)
    found = divergence.divergence(df, least=5, top=4)
    assert sorted(map(tuple, found.collect())) == sorted(plain_divergence(rows, 5, 4))
    assert divergence.divergence(df.limit(0)).count() == 0


def test_divergence_with_rows_of_blocks_in_any_order(spark, monkeypatch):
    """On several executors the rows of a block come as they are fetched; every block has an order of its own."""

    plain = GroupedData.applyInArrow

    def turned(self, function, schema):
        def mixed(key, table):
            return function(key, table.take(np.random.RandomState(key[1].as_py()).permutation(len(table))))

        return plain(self, mixed, schema)

    monkeypatch.setattr(GroupedData, "applyInArrow", turned)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 2)
    dice = random.Random(4)
    rows = [(" ".join(dice.choices("abcdefghijklmnop", k=9)), "en", dice.choice("stuvw")) for _ in range(200)]
    found = divergence.divergence(spark.createDataFrame(rows, "text string, lang string, source string"), least=5, top=4)
    assert sorted(map(tuple, found.collect())) == sorted(plain_divergence(rows, 5, 4))


def test_equal_subtrees_share_a_node():
    counts = np.array([[1, 2, 0, 0, 1, 2, 0, 0], [0, 0, 0, 0, 1, 2, 0, 0], [1, 2, 0, 0, 1, 2, 0, 0]])
    roots, levels = divergence.consed(counts)
    assert roots[0] == roots[2] != roots[1]
    assert [len(x) for x in levels] == [2, 2, 2]  # roots; (1 2 0 0) and (0 0 0 0); (1 2) and (0 0)
    value = divergence.walk(roots, levels, np.array([0, 0]), np.array([1, 2]), lambda g, c: c * 10)
    assert value.tolist() == [30, 0]


def test_prices_of_large_counts_are_exact():
    counts, totals = np.array([10 ** 13, 3]), np.array([10 ** 14, 10 ** 14])
    assert divergence.prices(counts, totals, 7).tolist() == [
        1 + 10 ** 9 * (c + 5) // (10 ** 14 + 35) for c in counts.tolist()]


@pytest.mark.parametrize("name", ["op11_embedding_near_dedup", "op12_conversation_repair", "op13_source_divergence"])
def test_sql_with_odd_rows(spark, tmp_path, name):
    """The registered queries and their SQL on small tables with nulls, ties and copies."""

    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "", "src0", 0), (9003, "Él É", "en", None, 4)],
                                documents.schema)
    documents.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    given = [(k, v) for k, v in vectors(4) if k is not None]
    once = {k: v for k, v in given if k < 9000 or v is None or len(v) == 24}
    spark.createDataFrame([(k, v, 1) for k, v in once.items()],
                          "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(
        f"{tmp_path}/embeddings.parquet")
    rows = [r for r in one_text_per_turn(conversations(9)) if len(r[3] or "") < 1000 and r[0] not in (900, 901)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(
        f"{tmp_path}/conversations.parquet")
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    assert difference(queries.QUERIES[name](spark, str(tmp_path)), connection, queries.ORACLES[name]) == ""

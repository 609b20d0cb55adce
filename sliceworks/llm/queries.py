"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sliceworks.llm import (byte_bpe, chat, divergence, embeddings, language, packing, quality, repair,
                            sharding, simhash, substrings, topk, toxicity)
from sliceworks.llm.common import add_columns, crc_of, slices

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under a name."""

    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and verdict of every document."""

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(documents, table(spark, sf_dir, "labels"))
    return quality.quality_columns(documents, model).select(
        "doc_id", *quality.BASE, "base_failed", "kept", "quality_score")


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from three quarters of the ids."""

    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_of("doc_id") % 4 == 2
    model = language.fit_languages(language.learnable(documents, held_out))
    return language.predict_languages(documents.withColumn("held_out", held_out), model).select(
        "doc_id", "held_out", "lang_pred", "score")


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in windows of 4096 tokens."""

    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"),
                          public_tokenizers.path("word_bpe_49k.json"), as_bytes=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@query("op4_topk_search", """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank
    FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""")
def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best candidates of every hundredth vector."""

    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"),
                      F.col("vec_id") % 100 == 0)


@query("op5_substring_dedup", r"""
WITH words AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
    SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS s
    FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS p FROM words)),
firsts AS (
    SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM windows),
gone AS (
    SELECT DISTINCT doc_id, unnest(generate_series(p, p + 19)) AS p FROM firsts WHERE k > 1),
spread AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
kept AS (
    SELECT spread.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
    FROM spread ANTI JOIN gone USING (doc_id, p) GROUP BY spread.doc_id)
SELECT words.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)""")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the windows of 20 words that start earlier too."""

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(documents).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document under 40 and 41 shards, and its slot."""

    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to."""

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks,
                                    public_tokenizers.PATTERN).drop("text", "ends")
    start = byte_bpe.decoder(spark, ranks)

    def begin():
        decode = start()

        def digests(lists: pa.Array):
            arrays = [x.astype("<u4") for x in byte_bpe.id_arrays(lists)]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            return ([len(x) for x in arrays], [sha(x.tobytes()) for x in arrays],
                    [sha(x.as_buffer()) for x in decode(lists)[0]])

        return digests

    # decoded and digested in one step, as each step has a Python process of its own on every core
    return add_columns(encoded, ["ids"], [("n_tokens", "bigint"), ("ids_sha256", "string"),
                                          ("decoded_sha256", "string")], None, start=begin,
                       arrow=True, drop=["ids"])


def chat_oracle() -> str:
    """SQL of op8: the markers' lengths by role, and one more character for each escape."""

    template = chat.Template()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    escapes = lambda c: " + ".join(
        [f"(len({c}) - len(replace({c}, '\\', '')))"]
        + [f"(len({c}) - len(replace({c}, {quoted(k)}, ''))) // {len(k)}" for k in template.controls()])
    known = " ".join(f"WHEN {quoted(r)} THEN {len(a) + len(z)}" for r, (a, z) in template.markers.items())
    other = sum(map(len, template.other))
    return f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                       FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(len(text) + {escapes("text")} + CASE role {known}
                ELSE {other} + len(role) + {escapes("role")} END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


@query("op8_chat_format", chat_oracle())
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(chat.format_chat(rows.unionByName(planted)))


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of the turns that formatted conversations, in order within partitions, hold."""

    kind = segments.schema["conv_id"].dataType
    schema = T.StructType([
        T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    class Digest:
        def __init__(self, key) -> None:
            self.key, self.reader = key, chat.Reader(chat.Template())
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
            self.n = self.loss_chars = self.chars = 0

        def feed(self, segment: str, loss: bool) -> None:
            self.chars += len(segment)
            for role, text, masked in self.reader.feed(segment, loss):
                self.n += 1
                self.turns.update(f"{role}\n{text}\n".encode())
                self.loss.update(masked.encode())
                self.loss_chars += len(masked)

        def row(self) -> tuple:
            return (self.key, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                    self.chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = None
        for batch in slices(batches, 4096):
            out = []
            for key, segment, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is None or digest.key != key:
                    out += [digest.row()] if digest else []
                    digest = Digest(key)
                digest.feed(segment, loss)
            if out:
                yield rows_of(out)
        if digest:
            yield rows_of([digest.row()])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
            names=schema.names)

    return segments.select("conv_id", "segment", "loss").mapInArrow(run, schema)


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""

    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from four fifths of the labelled ids."""

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_of("doc_id") % 5 == 0
    model = toxicity.fit_toxicity(documents, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score_toxicity(documents.withColumn("held_out", held_out), model).select(
        "doc_id", "held_out", "score", "predicted")


@query("op11_embedding_near_dedup", """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, component_id,
       e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id""")
def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""

    return embeddings.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: Costs by state with their audits and turns, as a struct so that the least sorts first; CRC32 by its table.
REPAIR_SQL = """
WITH RECURSIVE crc AS (
    SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
    FROM (SELECT unnest(range(256)) AS n)),
named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
drawn AS (
    SELECT named.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        string_split(k, ''), lambda x: unicode(x)::BIGINT)),
        lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 20 AS f FROM named, crc),
damaged AS (
    SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
           CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM drawn, range(2) copies(n) WHERE f <> 0 AND (n = 0 OR f = 3)),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
           rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare,
           role[1:1] || lead(role[1:1]) OVER (
               PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS two
    FROM damaged),
seen AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM numbered),
rows AS (
    SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate,
           bare <> '' AND NOT again AND bare[-1:] NOT IN ('.', '!', '?') AS truncated FROM seen),
stats AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
           count(*) FILTER (WHERE truncated) AS truncated,
           count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM rows GROUP BY conv_id),
way AS (
    SELECT conv_id, 0 AS i, {c: 0, a: '', r: ''} AS q0, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR) AS q1,
           {c: 2, a: 'I', r: chr(10) || 'user:'} AS q2,
           {c: 4, a: 'II', r: chr(10) || 'user:' || chr(10) || 'assistant:'} AS q3 FROM stats
    UNION ALL
    SELECT conv_id, i, n0, n1, list_min([m2, DO_I(n3, user)]), list_min([n3, DO_I(m2, assistant)])
    FROM (SELECT *, list_min([n2, DO_I(n0, user), DO_I(n1, user)]) AS m2
          FROM (SELECT way.conv_id, r.i, DO_D(q0) AS n0,
                       list_min([DO_D(q1), CASE WHEN ok AND x = 's' THEN DO_K(q0) END]) AS n1,
                       list_min([DO_D(q2), CASE WHEN ok THEN list_min([DO_R(q0, user), DO_R(q1, user),
                                 DO_R(q3, user)]) END, CASE WHEN ok AND x = 'u' THEN
                                 list_min([DO_K(q0), DO_K(q1), DO_K(q3)]) END]) AS n2,
                       list_min([DO_D(q3), CASE WHEN ok THEN DO_R(q2, assistant) END,
                                 CASE WHEN ok AND x = 'a' THEN DO_K(q2) END]) AS n3
                FROM way JOIN (SELECT *, NOT blank AND NOT duplicate AS ok, role[1:1] AS x,
                                      truncated::INTEGER AS more FROM rows) r
                ON r.conv_id IS NOT DISTINCT FROM way.conv_id AND r.i = way.i + 1))),
best AS (
    SELECT way.conv_id, list_min([q0, q3]) AS b FROM way JOIN stats
    ON stats.conv_id IS NOT DISTINCT FROM way.conv_id AND way.i = stats.n)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k
LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM k.conv_id"""


def repair_oracle() -> str:
    """SQL of op12, its four edits written out."""

    step = lambda cost, letter, turn: (
        lambda m: f"CASE WHEN {m[1]} IS NOT NULL THEN {{c: {m[1]}.c + {cost}, a: {m[1]}.a || '{letter}', "
                  f"r: {m[1]}.r{turn.format(m[2]) if turn else ''}}} END")
    out = REPAIR_SQL
    for name, cost, letter, turn in (("D", "3", "D", ""), ("K", "more", "K", " || chr(10) || role || ':' || text"),
                                     ("R", "2 + more", "R", " || chr(10) || '{}:' || text"),
                                     ("I", "2", "I", " || chr(10) || '{}:'")):
        out = re.sub(rf"DO_{name}\((\w+)(?:, (\w+))?\)", step(cost, letter, turn), out)
    return out


@query("op12_conversation_repair", repair_oracle())
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after planted damage."""

    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")), copies="copies")


@query("op13_source_divergence", r"""
WITH docs AS (
    SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT i, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, sum(c)::BIGINT AS n FROM cells GROUP BY ALL),
dense AS (
    SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
           1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(t.n, 0) + 5 * v) AS p
    FROM grp g JOIN kept k ON g.lang = k.lang JOIN sizes s ON s.lang = g.lang
    LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
    LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 5)) //
           (sum(sum(c)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
    FROM dense GROUP BY lang, term),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
               FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
               GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
    SELECT d.lang, d.source, 'term' AS part, d.term AS item, (p - q)::BIGINT AS value
    FROM dense d JOIN whole w ON d.lang = w.lang AND d.term = w.term WHERE c > 0 AND p > q),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50""")
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source's terms differ from those of the other sources of its language."""

    return divergence.divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))

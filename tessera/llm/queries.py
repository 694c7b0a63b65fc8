"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_folder, table
from tessera.llm.conversation_trie import conversation_trie
from tessera.llm.curriculum import plan_curriculum, stream_places
from tessera.llm.decontaminate import contaminated_pairs
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.line_quality import fit_quality
from tessera.llm.multi_index import search
from tessera.llm.near_dedup import near_components
from tessera.llm.pii import KINDS, find_personal_data, fit_spans
from tessera.llm.token_store import read_tokens, write_tokens
from tessera.llm.toxicity import fit_toxicity, held_out, score_texts
from tessera.llm.url_rules import judge_urls
from tessera.llm.warc import read_warc, write_warc
from tessera.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op1_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (WHERE f.k IS NOT NULL)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
GROUP BY doc_id
"""


@query
def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    planned = stream_places(plan_curriculum(docs, keep_text=False))
    return planned.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        F.get("positions", F.lit(0)).alias("first_position"),
        F.get("places", F.lit(0)).alias("first_place"),
        F.get("places", F.lit(1)).alias("second_place"),
    )


# The level is found as in the operator: sources by cap over weight, the first that its fair share does not overfill.
# The three positions are the inverses of the integrals of the three schedule shapes (rising, falling, hump).
ORACLES["op7_curriculum_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS o
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS r
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE r WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS cap
  FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM w
), t AS (
  SELECT source, r, source_size,
         least(cap, weight * (SELECT arg_min(lev, cap / weight) FROM l WHERE lev <= cap / weight)) AS target
  FROM l
), m AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.r,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY o ROWS UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE AS mid
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), f AS (
  SELECT *, CASE WHEN size > 0 THEN (mid < target)::INT + (mid + source_size < target)::INT ELSE 0 END AS copies
  FROM m
), c AS (
  SELECT doc_id, r, k, (mid + k * source_size) / target AS x FROM f, (VALUES (0), (1)) v(k) WHERE k < copies
), p AS (
  SELECT doc_id, k,
         CASE WHEN r = 0 THEN sqrt(0.25 + 2 * x) - 0.5
              WHEN r = 1 THEN 1.5 - sqrt(2.25 - 2 * x)
              WHEN x < 0.5 THEN (sqrt(0.25 + 4 * x) - 0.5) / 2
              ELSE 0.5 + (1.5 - sqrt(2.25 - 4 * (x - 0.5))) / 2 END AS position
  FROM c
), o AS (
  SELECT *, row_number() OVER (ORDER BY position, doc_id, k) - 1 AS place FROM p
)
SELECT f.doc_id, size, source_size, target, (copies * size)::BIGINT AS taken,
       a.position AS first_position, a.place AS first_place, b.place AS second_place
FROM f LEFT JOIN o a ON a.doc_id = f.doc_id AND a.k = 0 LEFT JOIN o b ON b.doc_id = f.doc_id AND b.k = 1
"""


@query
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), n=3, threshold="0.85")


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=5, coverage=0.8)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~out)
    scored = score_texts(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


@query
def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 5, 0)
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~out)
    scored = score_texts(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


def _joined_spans(spans: str):
    """kind:start:end of an array of spans by kind as listed, then start, comma-joined (kinds are told apart by rank)."""
    ranked = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("rank"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                s["kind"].alias("kind"),
            ),
        )
    )
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_personal_data(docs, fit_spans(docs))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined_spans("base"), 256).alias("base_sha256"),
        _joined_spans(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder, min_bytes=0, shard_bytes=1 << 25, roll_bytes=1 << 23)
    return read_warc(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


# Base 32: five hexadecimal digits are twenty bits are four characters.
ORACLES["op10_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), g AS (
  SELECT html, max(page_id) AS holder FROM p GROUP BY html
), h AS (
  SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS hex, holder FROM p JOIN g ON p.html = g.html
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                     (((('0x' || substr(hex, (5 * i + 1)::INT, 5))::INT >> s) & 31) + 1)::INT, 1)), 'string_agg', '')),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM h
"""


@query
def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query
def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings"), scale=64.0, shift=1_000_000, wanted=16)
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


@query
def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "tokens")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    write_tokens(table(spark, sf_dir, "documents"), folder, vocabulary, end_id=2, roll_ids=1 << 24, pieces="letters")
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


# CRC-32 bit by bit: each byte is followed by seven zeros, and every entry shifts once.  A node is a prefix (a list
# of role and text pairs); what hangs below it is found on the paths of the nodes' smallest members.
ORACLES["op13_conversation_trie"] = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, role, text) AS r
  FROM conversations WHERE conv_id IS NOT NULL
), h AS (
  SELECT c, n, c - c % 20 AS b,
         (xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''),
            lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
            lambda a, x: CASE WHEN xor(a, x) % 2 = 1 THEN xor(xor(a, x) // 2, 3988292384) ELSE xor(a, x) // 2 END),
            4294967295::BIGINT)) % 4 AS h
  FROM (SELECT c, count(*) AS n FROM t GROUP BY c)
), q AS (
  SELECT h.c, h.b, h.h, least(h.h, coalesce(o.n, 0)) AS q FROM h LEFT JOIN h o ON o.c = h.b
), z AS (
  SELECT q.c, t.r AS pos, t.role, t.text FROM q JOIN t ON t.c = q.b AND t.r <= q.h
  UNION ALL
  SELECT q.c, q.q + t.r - q.h, t.role, t.text FROM q JOIN t ON t.c = q.c AND t.r > q.h
), p AS (
  SELECT c, pos AS d, len(regexp_extract_all(text, '[^ 	-
]+')) AS words,
         sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '|')
                OVER (PARTITION BY c ORDER BY pos)) AS k
  FROM z
  UNION ALL SELECT c, 0, 0, '' FROM h
), e AS (
  SELECT c, max(d) AS d FROM p GROUP BY c
), n AS (
  SELECT p.d, p.k, min(p.c) AS m, count(*) AS n, any_value(words) AS words,
         coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (WHERE e.d = p.d), '') AS ends
  FROM p JOIN e ON p.c = e.c GROUP BY p.d, p.k
), u AS (
  SELECT n.*, o.k AS pk, o.m AS pm
  FROM n LEFT JOIN p a ON a.c = n.m AND a.d = n.d - 1 LEFT JOIN n o ON o.d = a.d AND o.k = a.k
), f AS (
  SELECT d - 1 AS d, pk AS k, count(*) AS children FROM u WHERE d > 0 GROUP BY ALL
), s AS (
  SELECT p.d, p.k, sum(CASE WHEN f.k IS NULL THEN 1 ELSE 0 END) AS leaves,
         sum(CASE WHEN u.d = 0 THEN 0 ELSE (u.n - 1) * u.words END) AS saved
  FROM u LEFT JOIN f ON f.d = u.d AND f.k = u.k JOIN p ON p.c = u.m AND p.d <= u.d GROUP BY p.d, p.k
)
SELECT u.m AS conv_id, u.d::BIGINT AS depth, u.pm AS parent_conv_id, u.n::BIGINT AS n_convs,
       coalesce(f.children, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens,
       sha256(u.ends) AS ends_sha256
FROM u JOIN s ON s.d = u.d AND s.k = u.k LEFT JOIN f ON f.d = u.d AND f.k = u.k
"""

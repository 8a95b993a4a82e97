"""The registered queries ``opN_<name>`` and their DuckDB SQL.

Each applies its operator, with production parameters, to the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm import audit, chat, decontam, jaccard, langid, lm, manifest, neardup, packing, secrets, sharding, toxicity, warc
from prefspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("op5_ngram_jaccard_join", rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[\x20\x09-\x0D]+'),
                             lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
hit AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM hit JOIN size sx ON sx.doc_id = x JOIN size sy ON sy.doc_id = y
         WHERE 100 * c >= 80 * (sx.n + sy.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN size s USING (doc_id)
JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = d.doc_id""")
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents")).drop("text_hash", "group_key")


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.drop("row", "ids")


@query("op8_lm_scoring")
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


_WORDS7 = rf"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
                           lambda x: x <> '')"""


@query("op7_winnowing_decontamination", rf"""
WITH d AS (SELECT doc_id, {_WORDS7} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS7} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[k:k + least(13, len(ws)) - 1], ' ') AS g
        FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS k FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS g
        FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, k, occ.n, item_id FROM occ JOIN win ON occ.n = win.n AND occ.g = win.g),
words AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS c, string_agg(i, ',' ORDER BY i) AS s
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(w.c, 0) AS n_hit, coalesce(m.c, 0) AS n_items,
       sha256(coalesce(m.s, '')) AS items_sha256, coalesce(w.c, 0) > 0 AND 20 * coalesce(w.c, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words w USING (doc_id) LEFT JOIN named m USING (doc_id)""")
def op7_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.contamination(docs, bench).drop("hits", "text_hash")


@query("op1_toxicity_ordinal")
def op1_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # a null id has no checksum; such rows are neither held out nor learned from
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = langid.train(docs.where(~held))
    out = langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


@query("op6_extendible_sharding", rf"""
WITH r AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
                  lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)), 60, '0') AS code FROM documents),
p AS (SELECT substr(code, 1, d) AS prefix, d, sum(n_bytes) AS b, count(*) AS n
      FROM (SELECT *, unnest(range(0, 61)) AS d FROM r) GROUP BY 1, 2),
fit AS (SELECT r.doc_id, r.n_bytes, r.code, min(p.d) AS depth FROM r JOIN p ON substr(r.code, 1, p.d) = p.prefix
        WHERE p.b <= {sharding.SHARD_BYTES} OR p.n = 1 GROUP BY 1, 2, 3)
SELECT doc_id, n_bytes, substr(code, 1, depth) AS shard, CAST(depth AS INTEGER) AS depth FROM fit""")
def op6_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


_PAGE_KEY = "substr(md5(CAST(page_id AS VARCHAR)), 1, 2) = '7f' AND html <> ''"
#: one byte changed, or (every other page) one more
_DAMAGE = "concat(CASE WHEN substr(html, 1, 1) = '#' THEN '!' ELSE '#' END, substr(html, 1 + page_id % 2))"


@query("op9_warc_merkle_audit", rf"""
WITH r AS (SELECT page_id, coalesce({_PAGE_KEY}, false) AS damaged,
  concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
    'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, '')),
    chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS rec FROM pages)
SELECT page_id, CAST(strlen(rec) AS BIGINT) AS n_bytes, sha256(rec) AS record_sha256, damaged FROM r""")
def op9_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second replica is a copy of all pages in which each page whose id
    hashes to 7f has one byte changed or one byte more; the audit has to find
    those."""
    pages = table(spark, sf_dir, "pages")
    replica = F.expr(f"CASE WHEN {_PAGE_KEY.replace('VARCHAR', 'STRING')} THEN {_DAMAGE} ELSE html END")
    return warc.fixity_audit(pages, replica).select("page_id", "n_bytes", "record_sha256", "damaged")


@query("op10_embedding_near_dedup")
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"),
                      F.sha2("candidate", 256).alias("candidate_sha256"), "label", "probability", "is_secret")


_SPIKE = r"\### Assistant: </turn> ok"


@query("op12_chat_formatting", rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{_SPIKE}' UNION ALL SELECT -7, 1, 'assistant', '{_SPIKE}'),
f AS (SELECT *, length('### ' || replace(replace(replace(replace(replace(role, '%', '%25'), ':', '%3A'), '#', '%23'), '<', '%3C'), chr(10), '%0A')
                       || ': ' || replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') || '</turn>' || chr(10)) AS chars FROM c),
r AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (WHERE role = 'assistant') AS n_examples,
  CAST(coalesce(sum(upto) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS expanded_chars
FROM r GROUP BY conv_id""")
def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one (-7) that speaks the template's own
    language."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    spike = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_SPIKE).alias("text"))
    return chat.read_back(chat.format_turns(given.union(spike)))


_WORDS13 = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query("op13_filter_interaction_audit", rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS13} AS ws, length(t) AS n, length(regexp_replace(t, '[A-Z]', '', 'g')) AS plain FROM d),
l AS (SELECT doc_id AS id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (n - plain) > 3 * n THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
      FROM w LEFT JOIN l ON l.id = w.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
      WHERE a.c NOT IN (b.c, c.c, d.c, e.c) AND b.c NOT IN (c.c, d.c, e.c) AND c.c NOT IN (d.c, e.c) AND d.c <> e.c),
s AS (SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
        coalesce(list_sum([1 << (ascii(substr(filter_order, j, 1)) - 65) for j in range(1, step)]), 0) AS earlier
      FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (CAST(earlier AS BIGINT) | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & bit <> 0 AND mask & CAST(earlier AS BIGINT) = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit <> 0 AND mask & CAST(earlier AS BIGINT) <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & bit <> 0 AND mask & CAST(earlier AS BIGINT) = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & bit <> 0 AND mask & CAST(earlier AS BIGINT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM cells, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""")
def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interaction_audit(audit.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


@query("op11_merkle_manifest", r"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text, row_number() OVER () AS rid FROM documents),
bits AS (SELECT id, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT id, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  FROM (SELECT id, k, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(substr(id, k // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x FROM bits WHERE k < 8 * length(id))),
crc AS (SELECT CAST(id AS BIGINT) AS id, xor(c, 4294967295) AS crc FROM bits WHERE k = 8 * length(id)),
v AS (SELECT rid, doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
        coalesce(crc % 2 = 0, false) AS tampered FROM d LEFT JOIN crc ON crc.id = d.doc_id),
l AS (SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || CASE WHEN text IS NULL THEN '-' WHEN tampered THEN strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')
                            ELSE strlen(text) || ':' || text END) AS given FROM v),
p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
node AS (SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM p
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM node WHERE n > 1 GROUP BY tree, level, n, pos // 3),
sub AS (SELECT tree, h AS subroot, level AS height FROM node WHERE n = 1),
up AS (SELECT 0 AS level, tree AS pos, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY level, n, pos // 3),
root AS (SELECT h AS root FROM up WHERE n = 1),
a AS (SELECT tree, level, pos, h FROM node WHERE n > 1
      UNION ALL SELECT -1, level, pos, h FROM up WHERE n > 1),
side AS (SELECT x.tree, x.level, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos < x.pos), '') AS l,
           coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos > x.pos), '') AS r
         FROM a x JOIN a y ON x.tree = y.tree AND x.level = y.level AND x.pos // 3 = y.pos // 3 GROUP BY 1, 2, 3),
walk AS (SELECT rid, tree AS own, tree, 0 AS level, pos, given AS h, '' AS proof, height AS height FROM p JOIN sub USING (tree)
  UNION ALL
  SELECT rid, own, nt, nl, np, nh, nproof, height FROM (
    SELECT w.rid, w.own, w.height,
      CASE WHEN w.tree >= 0 AND w.level = w.height THEN -1 ELSE w.tree END AS nt,
      CASE WHEN w.tree >= 0 AND w.level = w.height THEN 0 ELSE w.level + 1 END AS nl,
      CASE WHEN w.tree >= 0 AND w.level = w.height THEN w.own ELSE w.pos // 3 END AS np,
      CASE WHEN w.tree >= 0 AND w.level = w.height THEN w.h ELSE sha256(s.l || w.h || s.r) END AS nh,
      CASE WHEN w.tree >= 0 AND w.level = w.height THEN w.proof ELSE w.proof || s.l || s.r END AS nproof
    FROM walk w LEFT JOIN side s ON s.tree = w.tree AND s.level = w.level AND s.pos = w.pos
    WHERE (w.tree >= 0) OR s.tree IS NOT NULL) z),
ended AS (SELECT rid, h, proof FROM walk WHERE tree = -1 AND level = (SELECT max(level) FROM up))
SELECT p.doc_id, p.leaf, sub.subroot, root.root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = root.root AS verified
FROM p JOIN sub USING (tree) JOIN ended e USING (rid), root""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return manifest.verify(docs, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))

"""Queries of this subpackage under their registered names, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_audit.llm import (
    decontaminate,
    golay_simhash,
    line_dedup,
    merkle,
    multiset_hash,
    piece_nbest,
    quality_qda,
    token_planes,
    toxicity,
    turn_repair,
    url_markov,
    warc,
    window_dedup,
)
from corpus_audit.llm.common import lower_ascii, table

QUERIES, ORACLES = {}, {}


def tokenizer(name: str) -> str:
    """The file of a public tokenizer, asked for by the queries that need one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_token_planes")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_planes.write_ids(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_planes.read_ids(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
runs AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
         FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, runs.i, runs.k FROM runs JOIN win ON runs.s = win.s AND runs.k = win.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op2_decontaminate", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, chain).drop("text")
    return scored.withColumn("rejected", F.col("p_toxic") >= toxicity.REJECT)


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_qda.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op5_piece_nbest")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = piece_nbest.segment(docs, tokenizer("piece_bpe_32k.model"))
    return made.select(
        "doc_id",
        F.transform("segmentations", lambda s: s["score"]).alias("scores"),
        F.transform("segmentations", lambda s: s["n_pieces"]).alias("n_pieces"),
        F.transform("segmentations", lambda s: F.crc32(s["ids"])).alias("ids_crc32"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS d, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to FROM q
"""


@query("op6_warc", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query("op7_url_markov")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_markov.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT s, min(doc_id) AS a FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (s) WHERE doc_id > a),
lost AS (SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
         CASE WHEN gone IS NULL THEN w ELSE
              list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains(gone, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) END AS kept
         FROM d LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM kept
"""


@query("op8_window_dedup", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = window_dedup.mark_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.trim(F.regexp_replace(F.coalesce("kept_text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return marked.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query("op10_multiset_hash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = multiset_hash.compare_with_edits(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        multiset_hash.as_string(F.col("vector")).alias("fingerprint"),
        multiset_hash.as_string(F.col("edited_vector")).alias("edited_fingerprint"),
        multiset_hash.likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        multiset_hash.likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )


#: Unsigned crc32 of a short ASCII string, bit by bit.
CRC32_SQL = """xor(list_reduce(list_transform(range(1, length({s}) + 1), lambda i: CAST(ascii(substr({s}, CAST(i AS INT), 1)) AS BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""


OP11_SQL = f"""
WITH RECURSIVE src AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
kinds AS (SELECT *, {CRC32_SQL.format(s="s")} % 20 AS kind FROM src),
damaged AS (SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
            unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, substr(role, 1, 1) AS c,
             trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM damaged),
again AS (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS twice, lead(c) OVER (PARTITION BY k ORDER BY i) AS next FROM numbered),
rows AS MATERIALIZED (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN twice THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM again),
counts AS (SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
           count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
           count(*) FILTER (WHERE c || next NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY k),
best AS (
  SELECT k, CAST(0 AS BIGINT) AS i, 0 AS st, {{'cost': CAST(0 AS BIGINT), 'audit': ''}} AS b FROM counts
  UNION ALL
  SELECT k, i, st, min(b) FROM (
    SELECT f.k, f.i + 1 AS i, CASE op WHEN 'D' THEN f.st WHEN 'K' THEN (CASE c WHEN 's' THEN 1 WHEN 'u' THEN 3 ELSE 2 END) ELSE (CASE f.st WHEN 3 THEN 2 ELSE 3 END) END AS st,
           {{'cost': f.cost + CASE op WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN op <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END, 'audit': f.audit || op}} AS b
    FROM (SELECT k, i, CASE WHEN ins = 0 THEN st WHEN st = 3 THEN 2 ELSE 3 END AS st, b.cost + 5 * ins AS cost, b.audit || repeat('I', ins) AS audit FROM best, (VALUES (0), (1)) x(ins)) f
    JOIN rows r ON r.k = f.k AND r.i = f.i + 1, (VALUES ('D'), ('K'), ('R')) o(op)
    WHERE op = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (op = 'R' OR (c = 's' AND f.st = 0) OR (c = 'u' AND f.st <> 3) OR (c = 'a' AND f.st = 3))))
  GROUP BY k, i, st),
ended AS (SELECT best.k, min({{'cost': b.cost + CASE st WHEN 1 THEN 10 WHEN 3 THEN 5 ELSE 0 END, 'audit': b.audit || CASE st WHEN 1 THEN 'II' WHEN 3 THEN 'I' ELSE '' END}}) AS b
          FROM best JOIN counts ON best.k = counts.k AND i = n GROUP BY best.k),
letters AS (SELECT k, b.audit AS audit, unnest(range(1, length(b.audit) + 1)) AS p FROM ended),
edits AS (SELECT k, p, audit[p] AS op, sum(CAST(audit[p] <> 'I' AS INT)) OVER w AS i, sum(CAST(audit[p] <> 'D' AS INT)) OVER w AS o FROM letters WINDOW w AS (PARTITION BY k ORDER BY p)),
placed AS (SELECT e.k, e.p, e.op, e.o, r.role, r.text, first(e.op = 'K' AND r.c = 's') OVER (PARTITION BY e.k ORDER BY e.p) AS system
           FROM edits e LEFT JOIN rows r ON r.k = e.k AND r.i = e.i AND e.op <> 'I' WHERE e.op <> 'D'),
repaired AS (SELECT k, string_agg(CASE WHEN op = 'K' THEN role WHEN (o - CAST(system AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END,
                                  chr(10) ORDER BY p) AS lines FROM placed GROUP BY k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM src) LEFT JOIN counts USING (k) LEFT JOIN ended USING (k) LEFT JOIN repaired USING (k)
"""


@query("op11_turn_repair", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    audits, turns = turn_repair.repair(turn_repair.damage(conversations))
    hashes = turn_repair.digests(turns).select(F.col("conv_id").alias("h"), "sha256")
    audits = audits.withColumnRenamed("conv_id", "a")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(audits, every["conv_id"].eqNullSafe(audits["a"]), "left").join(hashes, every["conv_id"].eqNullSafe(hashes["h"]), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _op12_sql(levels: int = 7, tops: int = 4) -> str:
    """Trees of up to 8^7 leaves, and a tree of up to 8^4 groups, level by level."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    field = "coalesce(CAST(octet_length(encode({0})) AS VARCHAR) || ':' || {0}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = CRC32_SQL.format(s="CAST(doc_id AS VARCHAR)")
    parts = [
        f"d AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, {leaf('text')} AS leaf, "
        f"CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS t FROM documents)",
        "n0 AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d FROM d)",
        "p0 AS MATERIALIZED (SELECT doc_id, g, leaf, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, t AS cur, '' AS proof, '' AS subroot FROM d)",
    ]

    def level(k):
        parts.append(f"r{k} AS MATERIALIZED (SELECT g, i // 8 AS run, list(d ORDER BY i) AS ds, sum(count(*)) OVER (PARTITION BY g) AS total FROM n{k} GROUP BY g, i // 8)")
        parts.append(f"n{k + 1} AS MATERIALIZED (SELECT g, run AS i, CASE WHEN total > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM r{k})")
        parts.append(
            f"p{k + 1} AS MATERIALIZED (SELECT doc_id, p.g, leaf, i // 8 AS i, CASE WHEN total > 1 THEN sha256(array_to_string(ds[1:i % 8], '') || cur || array_to_string(ds[i % 8 + 2:], '')) ELSE cur END AS cur,"
            f" CASE WHEN total > 1 THEN proof || array_to_string(ds[1:i % 8], '') || array_to_string(ds[i % 8 + 2:], '') ELSE proof END AS proof, subroot"
            f" FROM p{k} p JOIN r{k} r ON p.g = r.g AND p.i // 8 = r.run)"
        )

    for k in range(levels):
        level(k)
    k = levels + 1
    parts.append(f"n{k} AS MATERIALIZED (SELECT 0 AS g, g AS i, d FROM n{levels})")
    parts.append(f"p{k} AS MATERIALIZED (SELECT doc_id, 0 AS g, leaf, p.g AS i, cur, proof, n.d AS subroot FROM p{levels} p JOIN n{levels} n ON p.g = n.g)")
    for k in range(levels + 1, levels + 1 + tops):
        level(k)
    k = levels + 1 + tops
    return f"""WITH {', '.join(parts)}
SELECT doc_id, leaf, subroot, n.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = n.d AS verified FROM p{k} p, n{k} n"""


@query("op12_merkle", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    made = merkle.manifest(docs, tampered=merkle.record_hash("doc_id", "source", "lang", "n_chars", text))
    made = made.withColumn("folded_root", merkle.folded(F.col("tampered"), F.col("witness")))
    return made.select(
        "doc_id", "leaf", "subroot", "root", merkle.witness_hash(F.col("witness")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


OP13_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, pos, line, keeper IS NOT NULL AND doc_id < keeper AS gone FROM keyed LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""


@query("op13_line_dedup", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))

"""The registered queries of the training-data operators and their SQL twins.

Each query applies its operator with production parameters to a whole table and
derives the digest columns of its contract from the operator's real output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conv_trie, decontam, exact_dedup, html_main, langid, line_dedup, merkle, near_dedup, pii, repeats, secrets, token_files
from .common import materialize, scratch_path, table


#: Production passes a secret key; this one keeps the registered query repeatable.
PII_KEY = b"ledgerlake registered query"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    n = lambda *kinds: F.size(F.filter("_pii_spans", lambda s: s["kind"].isin(*kinds))).cast("long")
    return done.select(
        "doc_id",
        "text",
        F.size("_pii_spans").cast("long").alias("n_entities"),
        n("email").alias("n_email"),
        n("phone").alias("n_phone"),
        n("card").alias("n_card"),
        n("ip").alias("n_ip"),
        n("given", "family").alias("n_name"),
        n("ssn", "iban").alias("n_other"),
        F.array_join(
            F.transform("_pii_spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        ).alias("spans"),
    )


def op7_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_main.extract_main_text(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_template")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _joined(spans):
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size("links").cast("long").alias("n_links"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(~langid.held_out()))
    return langid.classify(docs, model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected"
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontam.mark(
        decontam.find_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    )
    items = F.array_sort(F.array_distinct(F.transform("_dc_matches", lambda m: m["item"])))
    return marked.select(
        "doc_id",
        F.col("_dc_n_words").alias("n_words"),
        F.col("_dc_n_hit").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("_dc_contaminated").alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS k, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM bw),
ks AS (SELECT DISTINCT k FROM win),
dp AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
occ AS (SELECT dp.doc_id, dp.i, dp.k, win.item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM dp) dp JOIN win ON dp.k = win.k AND dp.s = win.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.col("_ld_lines").alias("n_lines"),
        F.col("_ld_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    )
    return token_files.checked_tokens(spark, path)


#: unsigned CRC-32 of the decimal text of a whole number, bit by bit
CRC32_SQL = """xor(list_reduce(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda a, c: list_reduce(range(8), lambda b, k: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END, xor(a, c)),
  CAST(4294967295 AS BIGINT)), 4294967295)"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(altered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claim = merkle.leaf_of([text if c == "text" else F.col(c) for c in merkle.FIELDS])
    done = merkle.manifest(docs, claim=claim)
    return done.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


OP11_SQL = """
WITH RECURSIVE
s AS (
  SELECT doc_id, source, replace(text, chr(10), '') AS cut, {crc} % 2 = 0 AS altered, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
      || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head
  FROM documents),
d AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN altered THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-'))
              ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS claim
  FROM s),
l AS (
  SELECT doc_id, leaf, claim, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n
  FROM d),
up AS (
  SELECT g, 0 AS lvl, i, n, leaf AS h FROM l
  UNION ALL
  SELECT g, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY g, lvl, i // 3, n),
sub AS (SELECT g, h FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, g AS i, (SELECT count(*) FROM sub) AS n, h FROM sub
  UNION ALL
  SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 3, n),
side AS (
  SELECT a.g, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rgt
  FROM up a JOIN up b ON a.g = b.g AND a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.g, a.lvl, a.i),
topside AS (
  SELECT a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rgt
  FROM top a JOIN top b ON a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.lvl, a.i),
walk AS (
  SELECT g, i AS leaf_at, 0 AS lvl, i, claim AS h, '' AS proof FROM l
  UNION ALL
  SELECT w.g, w.leaf_at, w.lvl + 1, w.i // 3, sha256(lft || w.h || rgt), w.proof || lft || rgt
  FROM walk w JOIN side s ON w.g = s.g AND w.lvl = s.lvl AND w.i = s.i),
high AS (
  SELECT g, leaf_at, 0 AS lvl, g AS i, h, proof FROM (SELECT *, row_number() OVER (PARTITION BY g, leaf_at ORDER BY lvl DESC) AS k FROM walk) WHERE k = 1
  UNION ALL
  SELECT w.g, w.leaf_at, w.lvl + 1, w.i // 3, sha256(lft || w.h || rgt), w.proof || lft || rgt
  FROM high w JOIN topside s ON w.lvl = s.lvl AND w.i = s.i)
SELECT l.doc_id, l.leaf, sub.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM l JOIN sub ON l.g = sub.g
JOIN (SELECT *, row_number() OVER (PARTITION BY g, leaf_at ORDER BY lvl DESC) AS k FROM high) f ON f.g = l.g AND f.leaf_at = l.i AND f.k = 1
CROSS JOIN (SELECT h FROM top WHERE n = 1) r
""".replace("{crc}", CRC32_SQL.format("doc_id"))


def op12_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
since AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM win JOIN since ON win.h = since.h WHERE since.first < win.doc_id),
each AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT e.rid, string_agg(e.word, ' ' ORDER BY e.p) AS s FROM each e ANTI JOIN gone g ON e.rid = g.rid AND e.p = g.p GROUP BY e.rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.rid = n.rid LEFT JOIN kept ON d.rid = kept.rid
"""


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = materialize(conv_trie.turn_arrays(table(spark, sf_dir, "conversations")), "conversations")
    heads = arrays.select(F.col("conv").alias("base"), F.slice("turns", 1, 8).alias("head"))
    h = (F.crc32(F.col("conv").cast("string")) % 9).cast("int")
    both = arrays.withColumn("base", F.col("conv") - F.col("conv") % 5).join(heads, "base", "left")
    none = F.array().cast("array<binary>")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return conv_trie.trie(both.select("conv", F.concat(F.coalesce(F.slice("head", F.lit(1), h), none), own).alias("turns")))


OP13_SQL = """
WITH own AS (
  SELECT conv_id, {crc} % 9 AS h, conv_id - conv_id % 5 AS base,
         list(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS keys,
         list(strlen(coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS sizes
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
seq AS (
  SELECT o.conv_id, list_concat(coalesce(b.keys[1:o.h], []), o.keys[o.h + 1:]) AS keys, list_concat(coalesce(b.sizes[1:o.h], []), o.sizes[o.h + 1:]) AS sizes
  FROM own o LEFT JOIN own b ON b.conv_id = o.base),
pre AS (
  SELECT conv_id, len(keys) AS len, d, array_to_string(keys[1:d], '') AS path, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size
  FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS d FROM seq)),
node AS (
  SELECT path, d, min(conv_id) AS low, count(*) AS n, any_value(size) AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = d), '')) AS ends
  FROM pre GROUP BY path, d),
kids AS (SELECT left(path, 64 * (CAST(d AS INT) - 1)) AS path, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
sub AS (
  SELECT left(n.path, 64 * CAST(a.d AS INT)) AS path, a.d, count(*) FILTER (coalesce(k.n, 0) = 0) AS leaves, sum((n.n - 1) * n.size) AS saved
  FROM node n LEFT JOIN kids k ON k.path = n.path AND k.d = n.d, LATERAL (SELECT unnest(range(0, n.d + 1)) AS d) a GROUP BY ALL)
SELECT n.low AS conv_id, n.d AS depth, p.low AS parent_conv_id, n.n AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, sub.leaves AS n_leaves,
       CAST(sub.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM node n JOIN sub ON sub.path = n.path AND sub.d = n.d
LEFT JOIN kids k ON k.path = n.path AND k.d = n.d
LEFT JOIN node p ON n.d > 0 AND p.d = n.d - 1 AND p.path = left(n.path, 64 * (CAST(n.d AS INT) - 1))
""".replace("{crc}", CRC32_SQL.format("conv_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_html_main": op7_html_main,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_files": op9_token_files,
    "op10_near_dedup": op10_near_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_repeated_phrases": op12_repeated_phrases,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": OP5_SQL,
    "op6_decontamination": OP6_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_repeated_phrases": OP12_SQL,
    "op13_conversation_trie": OP13_SQL,
}

"""Queries over the corpus operators, and the SQL to check them where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import conversation_trie, decontamination, html_extraction, media, mixing, quality, sharding, simhash, source_audit, suffix_dedup, suffix_trees, tokens, toxicity
from .common import held_out, pin, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = pin(quality.statistics(table(spark, sf_dir, "documents")), "statistics")
    model = quality.learn(stats, table(spark, sf_dir, "labels"))
    scored = quality.score(stats, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = pin(media.store_text(table(spark, sf_dir, "documents")), "media")
    return media.read_samples(media.inspect(stored))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.write_and_check(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "finish")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard")
    )


def op11_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.remove_repeated_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(*conversation_trie.spliced(conversation_trie.turns(table(spark, sf_dir, "conversations")))).drop("preorder", "subtree_end")


QUERIES = (
    op1_decontamination, op2_simhash, op3_quality, op4_main_text, op5_toxicity, op6_suffix_dedup, op7_media, op8_tokens, op9_mix_sources, op10_shards, op11_window_dedup, op12_source_audit,
    op13_conversation_trie,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM i WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT size FROM iw),
     dw AS (SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
     m AS (SELECT doc_id, item_id, k, size FROM dw JOIN iw USING (size, win)),
     h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM m) GROUP BY 1),
     f AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)""",
    "op11_window_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     win AS (SELECT doc_id, k, array_to_string(w[k:k + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20)),
     later AS (SELECT doc_id, k FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, k) > 1),
     gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS p FROM later),
     words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
     kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
     n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_source_audit": rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
             regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
     t AS (SELECT lang, source, doc, unnest(terms) AS term FROM d),
     kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
     langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
     groups AS (SELECT DISTINCT lang, source FROM d),
     counts AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
     sizes AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
     p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
             1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(s.n, 0) + 5 * l.v) AS p,
             1 + (1000000000::HUGEINT * (k.total + 5)) // (l.n + 5 * l.v) AS q
           FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
             LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
     apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
               FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
               UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50""",
    # crc32 of the id's digits, bit by bit: a digit is taken in, then eight shifts.
    "op13_conversation_trie": """
WITH t AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
     c AS (SELECT conv_id, own, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 6 AS h FROM t),
     b AS (SELECT c.conv_id, list_concat(coalesce(base.own, [])[1:c.h], c.own[c.h + 1:]) AS turns FROM c LEFT JOIN t base ON base.conv_id = c.conv_id - c.conv_id % 100),
     p AS (SELECT conv_id, len(turns) AS length, unnest(range(0, len(turns) + 1)) AS depth, turns FROM b),
     n AS (SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256,
             CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(turns[depth].x) END AS saved FROM p GROUP BY depth, turns[1:depth], turns[depth].x),
     k AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
     m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.depth = n.depth AND k.path = n.path),
     s AS (SELECT a.depth, a.path, sum((b.n_children = 0)::INT) AS n_leaves, sum(b.saved) AS saved_tokens FROM m a JOIN m b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY ALL),
     f AS (SELECT m.*, s.n_leaves, s.saved_tokens FROM m JOIN s ON s.depth = m.depth AND s.path = m.path)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, f.n_leaves::BIGINT AS n_leaves, f.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f LEFT JOIN f u ON u.depth = f.depth - 1 AND u.path = f.path[1:f.depth - 1]""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)

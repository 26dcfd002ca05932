"""The queries of the operators, over the given tables, and their SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair,
    fill_in_middle,
    grouped_join,
    hash_tree,
    katz,
    packing,
    quality,
    records,
    secret_scan,
    speculative_bpe,
    trie_counts,
    url_filter,
    weighted_sampling,
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _starts_with(prefix: str):
    return lambda c: c.startswith(prefix)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scanned(_documents(spark, sf_dir).select("doc_id", "text"))
    code = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.filter(code, lambda c: ~c.startswith("random:"))
    count = [F.size(F.filter(code, _starts_with(f"{k}:"))).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select(
        "doc_id", *count[:3], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(code, ",").alias("spans"), count[3]
    )


WORD_VOCABULARY, BYTE_VOCABULARY, RANKED_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
WORD_END, BYTE_END, SEQUENCE = 2, 0, 2048


def op2_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = records.write_records(_documents(spark, sf_dir), WORD_VOCABULARY, WORD_END)
    return records.digests(index).withColumnRenamed("id", "doc_id")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_join.joined(_documents(spark, sf_dir), grouped_join.Near(words=3, hundredths=90))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.token_counts(_documents(spark, sf_dir), RANKED_VOCABULARY)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.edit_likeness(_documents(spark, sf_dir))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = speculative_bpe.encoded(_documents(spark, sf_dir), BYTE_VOCABULARY)
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return speculative_bpe.decoded(ids, BYTE_VOCABULARY).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


#: Hosts of the block list: a part of the name is one of these (fixed values).
LISTED_HOSTS = r"(^|[.-])(ads|adult|bets|casino|pills|porn|spam)[.-]"
URL_RULES = [
    url_filter.Rule("net/", "block"),
    url_filter.Rule("example.net/en/", "allow"),
    url_filter.Rule("example.com/de/", "block"),
    url_filter.Rule("org/fr/", "allow"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = pages.where(url_filter.host_of(F.col("url")).rlike(LISTED_HOSTS)).select(url_filter.canonical(F.col("url")))
    judged = url_filter.judged_urls(pages, listed, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces_of(_documents(spark, sf_dir), BYTE_VOCABULARY, BYTE_END, SEQUENCE)
    return packing.packed(pieces, SEQUENCE).withColumnRenamed("id", "doc_id")


def op9_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.corpus_scores(_documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(_documents(spark, sf_dir).select("doc_id", "text", "source"))
    return judged.select("doc_id", *quality.MEASURES, "base_failed", "kept")


#: 24 shards: three regions of two racks of four; the 25th opens a region of its own.
SHARD_TREE = hash_tree.even_tree(regions=3, racks=2, shards=4)


def op11_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return hash_tree.sharded(docs, SHARD_TREE, hash_tree.grown(SHARD_TREE)).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack"
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the hash of conversation and turn; nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    hurt = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    report, edits = conversation_repair.repaired(damaged(given))
    found = given.select("conv_id").distinct().withColumn("key", conversation_repair.key()).join(report, "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.join(conversation_repair.digests(edits), "key", "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.filled_in_middle(_documents(spark, sf_dir))
    again = fill_in_middle.restored(F.col("output"), F.col("form"))
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return made.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(again).alias("restored_sha256")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scans,
        op2_binary_records,
        op3_ngram_jaccard_join,
        op4_token_counts,
        op5_document_fingerprints,
        op6_bpe_round_trip,
        op7_url_filter,
        op8_best_fit_packing,
        op9_katz_scores,
        op10_quality_rules,
        op11_hash_tree_shards,
        op12_conversation_repair,
        op13_fill_in_middle,
    )
}


#: Shared parts of the SQL twins: words of a text, and A-Z lower-cased words.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWERED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _shifted(c: int, bits: int) -> int:
    return c if not bits else _shifted(c >> 1 ^ (0xEDB88320 if c & 1 else 0), bits - 1)


#: CRC-32 of each byte, for SQL that has no such function.
_CRC_TABLE = [_shifted(byte, 8) for byte in range(256)]

ORACLES = {
    "op3_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_LOWERED} AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        met AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
            FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT met.a, met.b FROM met JOIN n x ON x.doc_id = met.a JOIN n y ON y.doc_id = met.b
            WHERE 100 * met.n >= 90 * (x.n + y.n - met.n)),
        reach(a, b) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(r.component_id AS BIGINT) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
        JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id""",
    "op7_url_filter": r"""
        WITH p AS (
            SELECT page_id, url,
                translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1) AS query
            FROM pages),
        r(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
        q AS (SELECT *, regexp_replace(regexp_replace(query, '(?i)(^|&)(utm_[^=&]*|ref|fbclid|gclid)(=[^&]*)?', '', 'g'), '^&+', '') AS kept FROM p),
        c AS (
            SELECT page_id, host, path, CASE WHEN contains(url, '://') THEN
                regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical
            FROM q),
        listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|porn|spam)[.-]')),
        fit AS (
            SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM c JOIN r
            ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
            AND starts_with(path, substring(rule, strpos(rule, '/'))) GROUP BY page_id)
        SELECT c.page_id, host, path, rule,
            coalesce(verdict, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
        FROM c LEFT JOIN fit USING (page_id) LEFT JOIN listed ON listed.canonical = c.canonical""",
    "op10_quality_rules": f"""
        WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
        win AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)),
        again AS (SELECT doc_id, x FROM win GROUP BY ALL HAVING count(*) > 1),
        covered AS (SELECT DISTINCT win.doc_id, unnest([i, i + 1, i + 2]) AS i FROM win JOIN again ON again.doc_id = win.doc_id AND again.x = win.x),
        rep AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
        m AS (
            SELECT t.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
                CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
            FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id),
        f AS (
            SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
        b AS (
            SELECT *, [word_chars < 2 * n_words OR word_chars > 15 * n_words, 10 * n_symbols > n_words,
                n_dup_lines > 5 AND 10 * n_dup_lines > len(lines) * 3, 100 * n_repeat_words > 30 * n_words, base_failed] AS broken FROM f),
        e AS (SELECT doc_id, source, unnest(range(1, 6)) AS rule, unnest(broken) AS broke FROM b),
        h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (broke) AS failures FROM e GROUP BY source, rule),
        p AS (
            SELECT rule, sum(failures) / sum(n) AS mean,
                sum(failures * failures / n) / sum(n) - (sum(failures) / sum(n)) * (sum(failures) / sum(n)) - (sum(failures) / sum(n)) * (1 - sum(failures) / sum(n)) * count(*) / sum(n) AS between_
            FROM h GROUP BY rule),
        k AS (SELECT rule, mean, CASE WHEN between_ * 1000 > mean * (1 - mean) THEN mean * (1 - mean) / between_ ELSE 1000 END AS strength FROM p),
        r AS (SELECT source, rule, mean, n + strength AS weight, (failures + mean * strength) / (n + strength) AS rate FROM h JOIN k USING (rule)),
        l AS (SELECT source, rule, mean, rate - 2 * sqrt(rate * (1 - rate) / (weight + 1)) AS low FROM r),
        bad AS (SELECT source, rule FROM l WHERE low * (1 - mean) > 3 * mean * (1 - low)),
        gone AS (SELECT DISTINCT e.doc_id FROM e JOIN bad ON bad.rule IN (e.rule, 5) AND bad.source IS NOT DISTINCT FROM e.source WHERE broke)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM gone) AS kept FROM b""",
    "op11_hash_tree_shards": r"""
        WITH
        d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
        b AS (SELECT doc_id, key, hex(encode(text)) AS x FROM d),
        c AS (
            SELECT doc_id, key, CAST(len(x) // 2 + 8 AS BIGINT) AS size,
                xor(list_reduce(
                    list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(x, '..'), lambda h: CAST('0x' || h AS BIGINT))),
                    lambda a, v: xor(a >> 8, {crc_table}[xor(a & 255, v) + 1])), 4294967295) AS text_crc32
            FROM b),
        tree AS (SELECT CAST(i AS INT) AS shard, CAST(i // 4 AS INT) AS rack, CAST(i // 8 AS INT) AS region FROM range(25) r(i)),
        node(level, up, node, weight) AS (
            SELECT 'region', -1, region, count(*) FROM tree GROUP BY region
            UNION ALL SELECT 'rack', region, rack, count(*) FROM tree GROUP BY region, rack
            UNION ALL SELECT 'shard', rack, shard, 1 FROM tree),
        drawn AS (
            SELECT key, level, up, node, -ln((CAST('0x' || substr(md5(level || ' ' || node || ':' || key), 1, 13) AS BIGINT) + 0.5) / 4503599627370496) / weight AS draw
            FROM (SELECT DISTINCT key FROM d) JOIN node ON true),
        best AS (
            SELECT key, level, up, arg_min(node, draw) AS node, arg_min(node, draw) FILTER (level <> 'region' OR node < 3) AS old
            FROM drawn GROUP BY key, level, up),
        put AS (
            SELECT r.key, r.old AS region, k.old AS rack, s.old AS shard, CASE WHEN r.node = 3 THEN 24 ELSE s.old END AS grown_shard
            FROM best r JOIN best k ON k.key = r.key AND k.level = 'rack' AND k.up = r.old
            JOIN best s ON s.key = r.key AND s.level = 'shard' AND s.up = k.old WHERE r.level = 'region')
        SELECT doc_id, size, text_crc32, 'key' AS law, shard,
            row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard, region, rack
        FROM c JOIN put USING (key)""".replace("{crc_table}", f"({_CRC_TABLE}::BIGINT[])"),
    "op13_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                list_transform(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda x: len(x)) AS k
            FROM documents),
        h AS (
            SELECT doc_id, text, k, CAST(len(k) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(k) + 1) AS one, CAST('0x' || h[9:16] AS BIGINT) % (len(k) + 1) AS two,
                CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
                    WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
        c AS (
            SELECT *, CAST(coalesce(list_sum(k[1:least(one, two)]), 0) AS BIGINT) AS p,
                CAST(coalesce(list_sum(k[1:greatest(one, two)]), 0) AS BIGINT) AS q FROM h),
        t AS (SELECT *, substring(text, 1, p) AS prefix, substring(text, p + 1, q - p) AS middle, substring(text, q + 1) AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
        FROM t""",
}

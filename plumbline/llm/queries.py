"""Queries over the given tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import centroids, decontaminate, hard_negatives, html_text, line_dedup, minhash, mixing, quality, sharding, suffix_dedup, token_output, url_filter, warc
from plumbline.llm.common import shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]

#: A public byte-level vocabulary for many languages; read by the driver.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract_text(table(spark, sf_dir, "pages"))
    return text.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = minhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "class_size", "kept")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"), n=10)
    n_hit = F.aggregate(F.zip_with("hit_to", "hit_from", lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharding.ShardStore(spark, shared_folder(spark, "op5"))
    store.append(table(spark, sf_dir, "documents"))
    version = store.compact()
    placed = store.read(version, places=True)
    # Names of shards are unique to a run; their sizes and the places in them tell the layout.
    live = store.manifest(version).select(F.regexp_extract("path", r"/shards/(.*)$", 1).alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    return placed.join(live, "shard").select("doc_id", "shard", "place", "shard_rows", "shard_bytes", F.lit(version).cast("long").alias("version"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = quality.ledger(table(spark, sf_dir, "documents"))
    return records.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(F.col("failed"), quality.POLICIES[1])).alias("base_failed"),
        quality.passes(F.col("failed"), quality.CURRENT).alias("kept"),
        F.col("failed").alias("failed_bits"),
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule costs, from a stored ledger: the texts are read once, to write it."""
    store = shared_folder(spark, "ledger")
    quality.write_ledger(table(spark, sf_dir, "documents"), store)
    return quality.ablation(quality.read_ledger(spark, store))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix_dedup.cut_repeats(docs, length=200, keep="none")
    digest = cut.select("row", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("lo").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return suffix_dedup.row_keys(docs).join(digest, "row").drop("row")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_order(table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_output.write_shards(table(spark, sf_dir, "documents"), shared_folder(spark, "op9"), VOCABULARY)
    rows = shards.slots().select("slot", "shard", "place", F.sha2("tokens", 256).alias("tokens_sha256"))
    return rows.join(shards.owners(), "slot").select("slot", "shard", "place", "index", "n_tokens", F.col("ids").alias("doc_ids"), "tokens_sha256")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # Urls that no rule fits are allowed.
    return url_filter.apply_rules(pages, url_filter.CONTRACT_RULES)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, final = centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64)
    return centroids.with_inertia(rows, final).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "op12")
    warc.write_archives(table(spark, sf_dir, "pages"), path, min_bytes=1000)
    records = warc.read_archives(spark, path, payloads=False).filter("fault IS NULL")
    return records.select(warc.row_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.row_id("refers_to").alias("refers_to"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    relabelled = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), anchor=vec_id % 100 == 0, label=relabelled, n_positives=5, n_negatives=10, low=30, high=90, scale=256)


QUERIES: dict[str, Query] = {
    "op1_html_extract": op1_html_extract,
    "op2_minhash": op2_minhash,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_sharding": op5_sharding,
    "op6_quality_rules": op6_quality_rules,
    "quality_ablation": quality_ablation,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_mixing": op8_mixing,
    "op9_token_output": op9_token_output,
    "op10_url_filter": op10_url_filter,
    "op11_centroids": op11_centroids,
    "op12_warc": op12_warc,
    "op13_hard_negatives": op13_hard_negatives,
}

#: Of every passage, a hash of its bytes as hexadecimal digits; texts are cut into pieces first, for speed.
_OP7 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT r, j, substr(h, 2000 * j + 1, 2398) AS piece FROM (SELECT r, h, unnest(generate_series(0, (len(h) - 400) // 2000)) AS j FROM d WHERE len(h) >= 400)),
p AS (SELECT r, 1000 * j + k AS i, md5(substr(piece, 2 * k + 1, 400)) AS s FROM (SELECT r, j, piece, unnest(generate_series(0, (len(piece) - 400) // 2)) AS k FROM pieces)),
again AS (SELECT s FROM p GROUP BY s HAVING count(*) > 1),
hit AS (SELECT r, i FROM p SEMI JOIN again USING (s)),
marks AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM hit),
runs AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS n FROM marks),
spans AS (SELECT r, n, min(i) AS lo, max(i) + 200 AS hi FROM runs GROUP BY r, n),
gaps AS (SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS a, lo AS b, lo, hi FROM spans),
cut AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS tail, list(struct_pack(a := a, b := b) ORDER BY a) AS kept FROM gaps GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN tail IS NULL THEN h ELSE array_to_string(list_transform(kept, lambda x: substr(h, 2 * x.a + 1, 2 * (x.b - x.a))), '') || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Failure bits of each document, as f.
_OP6_FAILED = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS wl FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM grams JOIN twice USING (doc_id, g)) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(wl) - len(list_distinct(wl)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(wl) AS n_lines,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters
      FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * n_symbols > 5 * word_chars THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_upper > 30 * n_letters THEN 8 ELSE 0 END)
             + (CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 16 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS failed_bits FROM m)
"""

#: Vectors as whole numbers, and the centroids of each round; a round follows by name.
_OP11 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS j, v AS c FROM (SELECT v, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h FROM v) ORDER BY h NULLS LAST, v LIMIT 16)"""
for _t in range(4):
    _OP11 += f""",
a{_t} AS (SELECT r, vec_id, v, j, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, j) AS best FROM
         (SELECT r, vec_id, v, j, list_sum(list_transform(generate_series(1, 64), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS d FROM v, c{_t})) WHERE best = 1),
m{_t} AS (SELECT j, list(m ORDER BY i) AS c FROM (SELECT j, i, (s - ((s % n) + n) % n) // n AS m FROM
         (SELECT j, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT j, v, unnest(generate_series(1, 64)) AS i FROM a{_t}) GROUP BY j, i)) GROUP BY j),
c{_t + 1} AS (SELECT j, coalesce(m{_t}.c, c{_t}.c) AS c FROM c{_t} LEFT JOIN m{_t} USING (j))"""
_OP11 += """
SELECT vec_id, CAST(a3.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a3.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (j)
"""

SQL: dict[str, str] = {
    "op3_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
       FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
       FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item FROM dw JOIN bw USING (k, gram)),
spans AS (SELECT DISTINCT doc_id, i, k FROM hits),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM spans) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op4_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line, {_ASCII_LOWER.format("trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
      FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM d)),
common AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM l WHERE key NOT IN (SELECT key FROM common) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(kept.n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op6_quality_rules": _OP6_FAILED
    + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM f",
    "quality_ablation": _OP6_FAILED
    + """
SELECT 2 AS policy, rule, CAST(count_if((failed_bits & bit) <> 0) AS BIGINT) AS n_fail, CAST(count_if(failed_bits = bit) AS BIGINT) AS n_only
FROM f, (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('shouting', 8), ('repeated_lines', 16), ('word_length', 32)) AS rules(rule, bit) GROUP BY rule
""",
    "op7_suffix_dedup": _OP7,
    "op11_centroids": _OP11,
    "op12_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, strlen(html) AS n, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keeper FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to FROM m
""",
    "op13_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.id AS anchor_id, a.label, b.r AS o, b.id, b.label AS other, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.r <> b.r),
pos AS (SELECT r, anchor_id, id AS positive_id, o AS p, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id, o) AS n FROM s WHERE label = other) WHERE n <= 5),
neg AS (SELECT pos.anchor_id, positive_id, positive_score, s.id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY r, p ORDER BY score DESC, s.id, o) AS rank
        FROM pos JOIN s USING (r) WHERE label <> other AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10
""",
    "op10_url_filter": r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (SELECT page_id, max_by(h || rules.p, length(h || rules.p)) AS rule, max_by(verdict, length(h || rules.p)) AS verdict
         FROM p, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) AND host <> '' GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
""",
}

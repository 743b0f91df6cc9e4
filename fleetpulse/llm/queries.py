"""The registered query of each operator, with production parameters, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import alignment, extraction, jaccard, merkle, mixing, packing, preferences, quality, secrets, sharding, toxicity
from fleetpulse.llm import url_filter, vectors
from fleetpulse.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [secrets.count_of("base_spans", kind).cast("long").alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    base = F.sha2(secrets.span_text("base_spans"), 256).alias("base_sha256")
    return scanned.select("doc_id", *counts, base, secrets.span_text("all_spans").alias("spans"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is chosen; the rejected one leaves it after 1 to 3 turns for the conversation with the neighbouring id."""
    turns = table(spark, sf_dir, "conversations")
    cut = lambda pair: 1 + F.pmod(pair, F.lit(3))
    chosen = turns.withColumnRenamed("conv_id", "pair_id")
    partner = F.col("conv_id").bitwiseXOR(F.lit(1))
    kept = chosen.where(F.col("turn") < cut(F.col("pair_id"))).select("pair_id", "turn", "role", "text")
    other = turns.select(partner.alias("pair_id"), "turn", "role", "text").where(F.col("turn") >= cut(F.col("pair_id")))
    known = turns.select(F.col("conv_id").alias("pair_id")).distinct()
    rejected = kept.unionByName(other.join(known, "pair_id", "left_semi"))
    return preferences.format_preferences(chosen, rejected)


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of fetching follow from page ids; the list has up to twelve dated entries for each host of the pages and its parents."""
    start = F.to_date(F.lit("2024-01-01"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(start, (F.pmod(F.col("page_id") * 7, F.lit(365))).cast("int")))
    domains = pages.select(url_filter.host_of(F.col("url")).alias("host")).distinct()
    domains = domains.select(F.explode(url_filter.domains_of(F.col("host"))).alias("domain")).where("domain <> ''").distinct()
    months = domains.select("domain", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("month"))
    digit = F.substring(F.md5(F.concat_ws("#", "domain", "month")), 1, 1)
    listed_on = F.date_add(start, F.col("month") * 30 + F.ascii(digit) % 28)
    action = F.when(digit.isin("0", "1", "2", "3"), "block").when(digit.isin("4", "5", "6"), "allow")
    entries = months.select("domain", listed_on.alias("listed_on"), action.alias("action"))
    return url_filter.filter_urls(captures, entries).select("page_id", "host", "fetched_on", "domain", "listed_on", "blocked")


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = [f"shard-{i:02d}" for i in range(sharding.SHARDS)]
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.place(docs, F.col("doc_id"), shards).select("doc_id", "source", "slot", "shard")


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


@query
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.top_k(every, every.where("vec_id % 20 = 0"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.quality_rules(table(spark, sf_dir, "documents"), trusted)


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    columns = ["doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    return packed.select(*columns)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents")).proofs()


@query
def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_counts(table(spark, sf_dir, "documents"))


# SQL is given where it can say the same without floating-point thresholds or models; tests compare the others with plain versions.
ORACLE_SQL: dict[str, str] = {
    "op3_preferences": """
WITH known AS (SELECT DISTINCT conv_id FROM conversations),
sides AS (
  SELECT 0 AS side, conv_id AS pair_id, turn, role, text FROM conversations
  UNION ALL SELECT 1, conv_id, turn, role, text FROM conversations WHERE turn < 1 + conv_id % 3
  UNION ALL SELECT 1, xor(conv_id, 1), turn, role, text FROM conversations
    WHERE turn >= 1 + xor(conv_id, 1) % 3 AND xor(conv_id, 1) IN (SELECT conv_id FROM known)),
turns AS (
  SELECT pair_id, turn,
    list_sort(list([role, text]) FILTER (side = 0)) IS NOT DISTINCT FROM list_sort(list([role, text]) FILTER (side = 1)) AS same
  FROM sides GROUP BY pair_id, turn),
firsts AS (SELECT pair_id, coalesce(min(turn) FILTER (NOT same), 9223372036854775807) AS first FROM turns GROUP BY pair_id),
parts AS (
  SELECT s.*, CASE WHEN turn < first THEN 'prompt' WHEN side = 0 THEN 'chosen' ELSE 'rejected' END AS part,
    '<|' || role || '|>' || chr(10) AS head
  FROM sides s JOIN firsts f USING (pair_id) WHERE side = 0 OR turn >= first)
SELECT pair_id, part, turn, role, head || text || '<|end|>' || chr(10) AS rendered,
  CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(head) ELSE 0 END AS INTEGER) AS loss_start,
  CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(head) + length(text) + 7 ELSE 0 END AS INTEGER) AS loss_end
FROM parts""",
    "op4_url_filter": """
WITH captures AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    CAST(DATE '2024-01-01' + CAST(page_id * 7 % 365 AS INTEGER) AS DATE) AS fetched_on FROM pages),
suffixes AS (
  SELECT DISTINCT host, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS domain
  FROM (SELECT DISTINCT host FROM captures), range(1, 20) r(i)
  WHERE i <= greatest(len(string_split(host, '.')) - 1, 1)),
dated AS (
  SELECT domain, m, substr(md5(domain || '#' || m), 1, 1) AS digit
  FROM (SELECT DISTINCT domain FROM suffixes WHERE domain <> ''), range(0, 12) r(m)),
entries AS (
  SELECT domain, CAST(DATE '2024-01-01' + CAST(m * 30 + ascii(digit) % 28 AS INTEGER) AS DATE) AS listed_on,
    CASE WHEN digit <= '3' THEN 'block' ELSE 'allow' END AS action
  FROM dated WHERE digit BETWEEN '0' AND '6'),
daily AS (SELECT domain, listed_on, max(action) AS action FROM entries GROUP BY ALL),
held AS (SELECT *, lead(listed_on) OVER (PARTITION BY domain ORDER BY listed_on) AS valid_to FROM daily),
ranked AS (
  SELECT c.page_id, c.host, c.fetched_on, h.domain, h.listed_on, coalesce(h.action = 'block', false) AS blocked,
    row_number() OVER (PARTITION BY c.page_id ORDER BY length(h.domain) DESC NULLS LAST) AS n
  FROM captures c LEFT JOIN suffixes s ON c.host = s.host
    LEFT JOIN held h ON h.domain = s.domain AND h.listed_on <= c.fetched_on AND (h.valid_to IS NULL OR c.fetched_on < h.valid_to))
SELECT page_id, host, fetched_on, domain, listed_on, blocked FROM ranked WHERE n = 1""",
    "op5_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS shingle
    FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (shingle)
  WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT s.y, r.other FROM reach r JOIN steps s ON s.x = r.id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT id, min(other) AS least_id FROM reach GROUP BY id) ON id = d.doc_id""",
    "op7_mixing": """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
shares AS (
  SELECT source, greatest(1, 1024 * CAST(floor(sqrt(n)) AS BIGINT) // (SELECT CAST(sum(floor(sqrt(n))) AS BIGINT) FROM counts)) AS share
  FROM counts),
total AS (
  SELECT CAST(sum(share) AS BIGINT) AS cycle, list(share ORDER BY source) AS shares, list(source ORDER BY source) AS names FROM shares),
steps AS (
  SELECT CAST(-1 AS BIGINT) AS slot, list_transform(shares, lambda x: CAST(0 AS BIGINT)) AS had,
    CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS turn, cycle, shares, names FROM total
  UNION ALL
  SELECT slot + 1, list_transform(had, lambda h, i: CASE WHEN i = next THEN h + 1 ELSE h END), next, had[next], cycle, shares, names
  FROM (SELECT *, list_min(list_transform(range(1, len(shares) + 1), lambda i:
      CASE WHEN had[i] < shares[i] AND had[i] * cycle // shares[i] <= slot + 1
        THEN (((had[i] + 1) * cycle + shares[i] - 1) // shares[i]) * 10000 + i END)) % 10000 AS next
    FROM steps WHERE slot + 1 < cycle)),
slots AS (SELECT names[pick] AS source, turn, slot, shares[pick] AS share, cycle FROM steps WHERE slot >= 0),
numbered AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS source_row
  FROM documents)
SELECT doc_id, d.source, source_row, source_row // 64 AS block, (source_row // 64) * cycle // share AS release,
  ((source_row // 64 + 1) * cycle + share - 1) // share AS deadline, (source_row // 64 // share) * cycle + slot AS slot
FROM numbered d JOIN slots s ON d.source = s.source AND (source_row // 64) % share = turn""",
    "op8_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
}

"""Queries on deterministic ids, runtime chunks and external snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.text import slug
from ledgerline.operators import identity as idt
from ledgerline.sources.shared import ensure_checkpoints

from .corpus import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT p_partkey, 'atom-' || substr(sha256(p_name || '|' || p_brand || '|' || p_size || '|' || (p_size + 1)), 1, 16) AS atom_id, 'sha256:' || sha256(p_name) AS content_hash, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
 'hn-' || substr(sha256('html:' || p_brand || ':' || p_size), 1, 12) AS html_id FROM part""")
def deterministic_ids(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", idt.atom_id(F.col("p_name"), F.col("p_brand"), F.col("p_size"), F.col("p_size") + 1).alias("atom_id"), idt.content_hash(F.col("p_name")).alias("content_hash"), slug(F.col("p_name")).alias("slug"), idt.html_node_id(F.col("p_brand"), F.col("p_size")).alias("html_id"))


@query("""WITH n AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '_ ' ELSE '.' || url END AS id FROM pages), c AS (SELECT *, regexp_replace(regexp_replace(upper(id), '[^A-Z0-9._-]', '-', 'g'), '^[._-]+', '') AS clean FROM n)
SELECT page_id, CASE WHEN clean = '' THEN 'N-' || upper(substr(sha256(id), 1, 8)) ELSE clean END AS node_id FROM c""")
def safe_node_ids(spark, d):
    return table(spark, d, "pages").select("page_id", idt.safe_node_id(F.when(F.col("page_id") % 9 == 0, "_ ").otherwise(F.concat(F.lit("."), "url"))).alias("node_id"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' ELSE 'team-' || c_nationkey || '/' || replace(c_name, '#', '_') END AS repository FROM customer")
def repositories(spark, d):
    k = F.col("c_custkey") % 4
    name = F.concat(F.lit("team-"), "c_nationkey", F.when(k == 1, ":").otherwise("/"), F.replace("c_name", F.lit("#"), F.lit("_")))
    return table(spark, d, "customer").select("c_custkey", idt.repository_of(F.when(k == 0, "lonely").when(k == 1, F.concat(F.lit("git@host:"), name, F.lit(".git"))).when(k == 2, F.concat(F.lit("https://host/a/"), name, F.lit("/"))).otherwise(F.concat(F.lit(" ssh://host/"), name, F.lit(".git ")))).alias("repository"))


@query("""WITH n AS (SELECT p_partkey, ['document','chapter','section','article','paragraph','alinea','table'][p_partkey % 7 + 1] AS t, ['critical','high','medium','low'][p_size % 4 + 1] AS p, ['active','amended','repealed','pending','draft'][p_partkey % 5 + 1] AS s, p_name FROM part),
a AS (SELECT *, CASE WHEN t IN ('document','chapter') THEN 'authoritative' WHEN t IN ('section','article') THEN CASE WHEN p IN ('critical','high') THEN 'authoritative' ELSE 'reference' END WHEN t = 'paragraph' THEN 'reference' ELSE 'derived' END AS authority FROM n)
SELECT 'n' || p_partkey AS node_id, 'rag-' || substr(sha256('feed' || chr(0) || 'n' || p_partkey || chr(0) || sha256(p_name)), 1, 24) AS chunk_id, authority, CASE WHEN s = 'active' THEN CASE WHEN authority = 'derived' THEN 'medium' ELSE 'high' END WHEN s IN ('pending','draft','repealed') THEN 'low' ELSE 'medium' END AS confidence FROM a""")
def runtime_chunks(spark, d):
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    k = F.col("p_partkey")
    nodes = table(spark, d, "part").select(
        F.lit("feed").alias("feed_id"), F.concat(F.lit("n"), k).alias("node_id"), F.sha2("p_name", 256).alias("source_hash"), pick(("document", "chapter", "section", "article", "paragraph", "alinea", "table"), k % 7).alias("node_type"),
        pick(("critical", "high", "medium", "low"), F.col("p_size") % 4).alias("priority"), pick(("active", "amended", "repealed", "pending", "draft"), k % 5).alias("status"),
    )
    return idt.runtime_chunks(nodes)


RECORDS = """records AS (SELECT 's' || page_id // 2 AS source_id, 'v' || page_id AS version_id, url AS locator, 'SHA256:' || upper(sha256(html)) AS content_hash FROM pages),
leaves AS (SELECT row_number() OVER (ORDER BY source_id, version_id) - 1 AS idx, sha256('snapshot-record' || chr(0) || source_id || chr(0) || version_id || chr(0) || lower(content_hash)) AS hash FROM records)"""
ROOT = f"""WITH RECURSIVE {RECORDS}, n AS (SELECT count(*) AS n FROM leaves), l(lvl, idx, hash) AS (SELECT 0, idx, hash FROM leaves UNION ALL SELECT lvl + 1, idx // 2, sha256(min_by(hash, idx) || chr(10) || max_by(hash, idx)) FROM l WHERE (1 << lvl) < (SELECT n FROM n) GROUP BY lvl, idx // 2)"""


def _records(spark, d):
    return table(spark, d, "pages").select(F.concat(F.lit("s"), F.floor(F.col("page_id") / 2).cast("string")).alias("source_id"), F.concat(F.lit("v"), "page_id").alias("version_id"), F.col("url").alias("locator"), F.concat(F.lit("sha256:"), F.upper(F.sha2("html", 256))).alias("content_hash"), F.lit("2026-01-01T00:00:00Z").alias("captured_at"))


@query(f"{ROOT} SELECT count(DISTINCT source_id) AS sources, count(*) AS versions, 0 AS faults, (SELECT hash FROM l WHERE lvl = (SELECT max(lvl) FROM l)) AS root, 'root_differs' AS refusal FROM records")
def snapshot_verification(spark, d):
    """A snapshot whose stated root is another one: counts agree, the recomputed root refuses it."""
    ensure_checkpoints(spark)
    records = _records(spark, d)
    stated = table(spark, d, "pages").agg(F.lit("sha256:00").alias("root"), F.countDistinct(F.floor(F.col("page_id") / 2)).alias("sources"), F.count(F.lit(1)).alias("versions"))
    return idt.verify_snapshot(records, stated)


@query("""SELECT 's' || page_id // 2 AS source_id, CASE WHEN page_id % 10 = 4 THEN 'v' || (page_id + 1) WHEN page_id % 10 = 0 THEN ' ' ELSE 'v' || page_id END AS version_id, CASE WHEN page_id % 10 = 0 THEN 'malformed' WHEN page_id % 10 = 1 THEN 'unstable_hash' WHEN page_id % 10 = 2 THEN 'bad_captured_at' ELSE 'duplicate' END AS code FROM pages WHERE page_id % 10 <= 2
UNION ALL SELECT source_id, version_id, 'duplicate' FROM (SELECT 's' || page_id // 2 AS source_id, CASE WHEN page_id % 10 = 4 THEN 'v' || (page_id + 1) WHEN page_id % 10 = 0 THEN ' ' ELSE 'v' || page_id END AS version_id FROM pages) GROUP BY ALL HAVING count(*) > 1""")
def snapshot_record_findings(spark, d):
    k = F.col("page_id") % 10
    version = F.when(k == 4, F.concat(F.lit("v"), F.col("page_id") + 1)).when(k == 0, " ").otherwise(F.concat(F.lit("v"), "page_id"))
    rows = table(spark, d, "pages").select(F.concat(F.lit("s"), F.floor(F.col("page_id") / 2).cast("string")).alias("source_id"), version.alias("version_id"), F.col("url").alias("locator"), F.when(k == 1, "md5:1").otherwise(F.concat(F.lit("sha256:"), F.sha2("html", 256))).alias("content_hash"), F.when(k == 2, "yesterday").otherwise("2026-01-01T00:00:00Z").alias("captured_at"))
    return idt.record_findings(rows)

"""Queries on outlines, tree digests, envelope chains and sealed snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.canonical import canonical
from ledgerline.operators import graphs as gr
from ledgerline.operators import lexicon as lx
from ledgerline.operators import outlines as ol
from ledgerline.operators import seals as se
from ledgerline.operators import trees as tr
from ledgerline.operators.graphs import merkle_levels, sequenced
from ledgerline.sources.shared import ensure_checkpoints

from .corpus import table
from .identity import RECORDS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- outlines -------------------------------------------------------------------------------------------------------


def _outlines(spark, d):
    """A document's lines as an outline, and one extracted from it: entries renamed, at another depth, left out, and some moved down by seven."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("position", "line"))
    source = lines.select("doc", "position", F.substring("line", 1, 12).alias("title"), (F.col("position") % 3 + 1).alias("depth"))
    at = F.col("position")
    moved = source.where(at % 13 != 6).withColumn("to", at * 10 + F.when(at % 5 == 2, 75).otherwise(0))
    place = F.struct("to", F.when(at % 9 == 4, F.concat(F.lit("x"), "title")).otherwise(F.concat(F.lit(" "), F.replace("title", F.lit("e"), F.lit("E")))).alias("title"), F.when(at % 11 == 5, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"))
    rows = moved.groupBy("doc").agg(F.sort_array(F.collect_list(place)).alias("x")).select("doc", F.posexplode("x").alias("position", "e"))
    return source, rows.select("doc", "position", "e.title", "e.depth")


OUTLINES = """l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM documents),
s AS (SELECT doc, position, substr(line, 1, 12) AS title, position % 3 + 1 AS depth FROM l),
t AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY position * 10 + CASE WHEN position % 5 = 2 THEN 75 ELSE 0 END) - 1 AS position, CASE WHEN position % 9 = 4 THEN 'x' || title ELSE ' ' || replace(title, 'e', 'E') END AS title, CASE WHEN position % 11 = 5 THEN depth + 1 ELSE depth END AS depth FROM s WHERE position % 13 <> 6),
k AS (SELECT doc, lower(trim(title)) AS key, min(position) AS place, min_by(depth, position) AS first_depth FROM t GROUP BY ALL),
m AS (SELECT s.*, k.place, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.doc = s.doc AND lower(trim(t.title)) = lower(trim(s.title)) AND t.depth = s.depth) THEN s.depth ELSE k.first_depth END AS match_depth FROM s LEFT JOIN k ON k.doc = s.doc AND k.key = lower(trim(s.title))),
f AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY position) AS i, lag(place) OVER (PARTITION BY doc ORDER BY position) AS previous FROM m WHERE place IS NOT NULL),
x AS (SELECT doc, position, title, depth FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc = t.doc AND lower(trim(s.title)) = lower(trim(t.title)))),
plain AS (SELECT doc, 'missing' AS kind, position, title, depth, match_depth FROM m WHERE place IS NULL UNION ALL SELECT doc, 'depth', position, title, depth, match_depth FROM f WHERE depth <> match_depth
 UNION ALL SELECT doc, 'reordered', position, title, depth, match_depth FROM f WHERE place < previous UNION ALL SELECT doc, 'extra', position, title, NULL, depth FROM x)"""
RISING = """g(doc, i, lens, places) AS (SELECT DISTINCT doc, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM f
 UNION ALL SELECT g.doc, f.i, list_append(g.lens, 1 + coalesce(list_max(list_transform(list_filter(list_zip(g.lens, g.places), lambda z: z[2] <= f.place), lambda z: z[1])), 0)), list_append(g.places, CAST(f.place AS BIGINT)) FROM g JOIN f ON f.doc = g.doc AND f.i = g.i + 1),
e AS (SELECT doc, unnest(lens) AS len, generate_subscripts(lens, 1) AS i FROM (SELECT doc, arg_max(lens, i) AS lens FROM g GROUP BY doc)),
b(doc, i, len) AS (SELECT doc, max(i), any_value(len) FROM (SELECT *, max(len) OVER (PARTITION BY doc) AS most FROM e) WHERE len = most GROUP BY doc
 UNION ALL SELECT doc, i, len FROM (SELECT e.doc, e.i, e.len, row_number() OVER (PARTITION BY e.doc ORDER BY e.i DESC) AS n FROM b JOIN e ON e.doc = b.doc AND e.len = b.len - 1 AND e.i < b.i) WHERE n = 1)"""


@query(f"""WITH RECURSIVE {OUTLINES}, {RISING} SELECT doc, kind, CAST(position AS INTEGER) AS position, title, CAST(depth AS INTEGER) AS depth, CAST(match_depth AS INTEGER) AS match_depth FROM (SELECT * FROM plain
UNION ALL SELECT doc, 'moved', position, title, depth, match_depth FROM f WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc = f.doc AND b.i = f.i))""")
def toc_moves(spark, d):
    """Drifts between two outlines, moved entries told from those that others were moved past."""
    return ol.outline_drifts(*_outlines(spark, d))


@query(f"""WITH {OUTLINES}, c AS (SELECT doc, count(*) AS n, count(*) FILTER (place IS NOT NULL AND depth = match_depth) AS matched FROM m GROUP BY doc), o AS (SELECT doc, count(*) AS n FROM t GROUP BY doc), p AS (SELECT doc, count(*) AS drifts FROM plain GROUP BY doc)
SELECT c.doc, c.matched, coalesce(p.drifts, 0) AS drifts, c.matched / greatest(c.n, coalesce(o.n, 0)) AS score, coalesce(p.drifts, 0) = 0 AS aligned FROM c LEFT JOIN o ON o.doc = c.doc LEFT JOIN p ON p.doc = c.doc""")
def outline_scores(spark, d):
    return ol.outline_scores(*_outlines(spark, d))


# -- trees ----------------------------------------------------------------------------------------------------------

WIDTH = 16


def _tree(spark, d):
    """Regions, nations, customers and orders below one root, in the order of their keys."""
    t = lambda name: table(spark, d, name)
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = t("region").select(node("r", "r_regionkey").alias("node"), F.lit("root").alias("parent"), F.lit(1).alias("depth"), F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("payload"))
    rows = rows.unionByName(t("nation").select(node("n", "n_nationkey").alias("node"), node("r", "n_regionkey").alias("parent"), F.lit(2).alias("depth"), F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("payload")))
    rows = rows.unionByName(t("customer").select(node("c", "c_custkey").alias("node"), node("n", "c_nationkey").alias("parent"), F.lit(3).alias("depth"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("payload")))
    rows = rows.unionByName(t("orders").select(node("o", "o_orderkey").alias("node"), node("c", "o_custkey").alias("parent"), F.lit(4).alias("depth"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("payload")))
    root = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit("all").alias("payload"), F.lit(1).cast("long").alias("siblings"), F.lit(0).cast("long").alias("place"))
    return tr.placed(rows, "parent", ["key"]).drop("key").unionByName(root)


def _level_sql(k: int, nodes: str) -> str:
    """CTEs ``f{k}`` (folds of the children in ``d{k + 1}``) and ``d{k}`` (digests of ``nodes``)."""
    fold = f"""f{k}(lvl, parent, place, n, digest) AS (SELECT 0, parent, row_number() OVER (PARTITION BY parent ORDER BY key) - 1, count(*) OVER (PARTITION BY parent), digest FROM d{k + 1}
 UNION ALL SELECT lvl + 1, parent, place // {WIDTH}, (n + {WIDTH - 1}) // {WIDTH}, sha256(string_agg(digest, '' ORDER BY place)) FROM f{k} WHERE lvl = 0 OR n > 1 GROUP BY lvl, parent, place // {WIDTH}, n)"""
    return f"{fold}, d{k} AS (SELECT x.node, x.parent, x.key, sha256(x.payload || ':' || coalesce(f.digest, '')) AS digest FROM ({nodes}) x LEFT JOIN f{k} f ON f.parent = x.node AND f.lvl > 0 AND f.n = 1)"


TREE = ", ".join((
    "d4 AS (SELECT 'o' || o_orderkey AS node, 'c' || o_custkey AS parent, o_orderkey AS key, sha256(o_orderpriority || ':') AS digest FROM orders)", _level_sql(3, "SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS parent, c_custkey AS key, c_mktsegment AS payload FROM customer"),
    _level_sql(2, "SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent, n_nationkey AS key, n_name AS payload FROM nation"), _level_sql(1, "SELECT 'r' || r_regionkey AS node, 'root' AS parent, r_regionkey AS key, r_name AS payload FROM region"),
    _level_sql(0, "SELECT 'root' AS node, NULL AS parent, 0 AS key, 'all' AS payload"),
))


@query(f"WITH RECURSIVE {TREE} " + " UNION ALL ".join(f"SELECT node, digest FROM d{k}" for k in range(5)))
def tree_digests(spark, d):
    ensure_checkpoints(spark)
    return tr.tree_digests(_tree(spark, d), WIDTH).select("node", "digest")


@query("""SELECT 'o' || o_orderkey AS node, 'root/r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey || '/o' || o_orderkey AS path FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 500 = 3
UNION ALL SELECT 'c' || c_custkey, 'root/r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 40 = 9""")
def tree_tampering(spark, d):
    """Orders whose payload was changed and customers whose digest was, found with their ways from the root; a customer's changed digest is also wrong below its nation, whose own digest no longer follows."""
    ensure_checkpoints(spark)
    rows = tr.tree_digests(_tree(spark, d), WIDTH)
    key = F.expr("try_cast(substring(node, 2, 20) as bigint)")
    payload = F.when(F.col("node").startswith("o") & (key % 500 == 3), F.concat("payload", F.lit("!"))).when(F.col("node").startswith("c") & (key % 40 == 9), F.concat("payload", F.lit("?"))).otherwise(F.col("payload"))
    return tr.tampered_nodes(rows.withColumn("payload", payload), WIDTH).select("node", F.array_join("path", "/").alias("path"))


# -- envelope chains ------------------------------------------------------------------------------------------------

LINKS = 32


def _envelopes(spark, d):
    """Chains of up to 32 envelopes over the orders, some then altered, dropped, forked off or closed to a ring."""
    o = table(spark, d, "orders").select((F.col("o_orderkey") / LINKS).cast("long").alias("chain"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("content"))
    step = "aggregate(array_sort(collect_list(struct(k, content))), named_struct('h', cast(null as string), 'out', cast(array() as array<struct<k:bigint,content:string,previous:string,hash:string>>)), (a, x) -> named_struct('h', sha2(concat_ws(chr(0), x.content, coalesce(a.h, '')), 256), 'out', array_append(a.out, named_struct('k', x.k, 'content', x.content, 'previous', a.h, 'hash', sha2(concat_ws(chr(0), x.content, coalesce(a.h, '')), 256)))), a -> a.out)"
    chains = o.groupBy("chain").agg(F.expr(step).alias("links")).withColumn("ring", F.when(F.col("chain") % 40 == 3, F.element_at("links", -1)["hash"]))
    rows = chains.select("chain", "ring", F.posexplode("links").alias("i", "x")).select("ring", "i", "x.*")
    rows = rows.withColumn("previous", F.when((F.col("i") == 0) & F.col("ring").isNotNull(), F.col("ring")).otherwise(F.col("previous")))
    kept = rows.where("k % 70 <> 11").select(F.concat(F.lit("e"), "k").alias("envelope"), F.when(F.col("k") % 50 == 7, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"), "previous", "hash")
    fork = rows.where("k % 90 = 5").select(F.concat(F.lit("f"), "k").alias("envelope"), F.lit("fork").alias("content"), "previous", tr.envelope_hash(F.lit("fork"), F.col("previous")).alias("hash"))
    return kept.unionByName(fork)


ENVELOPES = f"""n AS (SELECT o_orderkey // {LINKS} AS chain, o_orderkey AS k, o_orderpriority AS content, row_number() OVER (PARTITION BY o_orderkey // {LINKS} ORDER BY o_orderkey) AS i FROM orders),
h(chain, i, k, content, previous, hash) AS (SELECT chain, i, k, content, CAST(NULL AS VARCHAR), sha256(content || chr(0) || '') FROM n WHERE i = 1 UNION ALL SELECT n.chain, n.i, n.k, n.content, h.hash, sha256(n.content || chr(0) || h.hash) FROM h JOIN n ON n.chain = h.chain AND n.i = h.i + 1),
r AS (SELECT k, content, hash, CASE WHEN i = 1 AND chain % 40 = 3 THEN last_value(hash) OVER (PARTITION BY chain ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE previous END AS previous FROM h),
e AS (SELECT 'e' || k AS envelope, CASE WHEN k % 50 = 7 THEN content || '!' ELSE content END AS content, previous, hash FROM r WHERE k % 70 <> 11 UNION ALL SELECT 'f' || k, 'fork', previous, sha256('fork' || chr(0) || coalesce(previous, '')) FROM r WHERE k % 90 = 5),
t AS (SELECT hash, min(envelope) AS target, count(*) AS alike FROM e GROUP BY hash), c AS (SELECT previous, count(*) AS heirs FROM e WHERE previous IS NOT NULL GROUP BY previous),
a AS (SELECT e.envelope, b.target AS before, sha256(e.content || chr(0) || coalesce(e.previous, '')) <> e.hash AS tampered, e.previous IS NOT NULL AND b.target IS NULL AS missing, coalesce(c.heirs, 0) > 1 AS forked, t.alike > 1 AS duplicate
      FROM e JOIN t ON t.hash = e.hash LEFT JOIN t b ON b.hash = e.previous LEFT JOIN c ON c.previous = e.previous),
w(envelope, start, length, broken) AS (SELECT envelope, envelope, CAST(0 AS BIGINT), CASE WHEN tampered OR missing THEN envelope END FROM a WHERE before IS NULL
      UNION ALL SELECT a.envelope, w.start, w.length + 1, coalesce(w.broken, CASE WHEN a.tampered OR a.missing THEN a.envelope END) FROM w JOIN a ON a.before = w.envelope)"""


@query(f"""WITH RECURSIVE {ENVELOPES} SELECT a.envelope, array_to_string(list_filter([CASE WHEN tampered THEN 'tampered' END, CASE WHEN missing THEN 'missing' END, CASE WHEN forked THEN 'forked' END, CASE WHEN duplicate THEN 'duplicate' END, CASE WHEN w.envelope IS NULL THEN 'cycle' END], lambda c: c IS NOT NULL), ',') AS codes,
w.start, w.length, w.broken FROM a LEFT JOIN w ON w.envelope = a.envelope""")
def envelope_chains(spark, d):
    """Tampered, missing and forked links told apart, rings found, and each envelope's first broken link; the SQL walks forward from the starts."""
    ensure_checkpoints(spark)
    return tr.chain_report(_envelopes(spark, d))


# -- sealed snapshots -----------------------------------------------------------------------------------------------

FORM = "external-snapshot/v1"


def _records(spark, d, changed: bool = False):
    html = F.when(F.col("page_id") % 17 == 3, F.concat("html", F.lit("x"))).otherwise(F.col("html")) if changed else F.col("html")
    return table(spark, d, "pages").select(F.concat(F.lit("s"), F.floor(F.col("page_id") / 2).cast("string")).alias("source_id"), F.concat(F.lit("v"), "page_id").alias("version_id"), F.col("url").alias("locator"), F.concat(F.lit("sha256:"), F.upper(F.sha2(html, 256))).alias("content_hash"), F.lit("2026-01-01T00:00:00Z").alias("captured_at"), "page_id")


def _root(records: str) -> str:
    return f"""WITH RECURSIVE {records}, n AS (SELECT count(*) AS n FROM leaves), l(lvl, idx, hash) AS (SELECT 0, idx, hash FROM leaves UNION ALL SELECT lvl + 1, idx // 2, sha256(min_by(hash, idx) || chr(10) || max_by(hash, idx)) FROM l WHERE (1 << lvl) < (SELECT n FROM n) GROUP BY lvl, idx // 2)"""


ROOT_NOW = "(SELECT hash FROM l WHERE lvl = (SELECT max(lvl) FROM l))"


@query(f"{_root(RECORDS)} SELECT '{FORM}' AS format, 'snap-1' AS snapshot_id, '2026-01-02T00:00:00Z' AS generated_at, 'exporter' AS producer, true AS immutable, count(DISTINCT source_id) AS source_count, count(*) AS version_count, 'sha256:' || {ROOT_NOW} AS content_hash_root, '' AS refusal FROM records")
def snapshot_seal(spark, d):
    ensure_checkpoints(spark)
    return se.seal(_records(spark, d), "snap-1", "exporter", "2026-01-02T00:00:00Z", FORM)


@query("""WITH c AS (SELECT count(DISTINCT page_id // 2) AS sources, count(*) AS versions FROM pages)
SELECT CASE WHEN v[1] = 'none' THEN ' ' ELSE v[1] END AS snapshot_id, sources, versions, CAST(0 AS BIGINT) AS faults, v[2] AS refusal FROM c, (SELECT unnest([['good', ''], ['form', 'bad_format'], ['none', 'no_id'], ['date', 'no_generated_at'], ['who', 'no_producer'], ['mutable', 'not_immutable'], ['rootless', 'no_root'], ['sources', 'count_mismatch'], ['versions', 'count_mismatch'], ['root', 'root_mismatch']]) AS v)""")
def snapshot_refusals(spark, d):
    """One accepted envelope and one for each ground of refusal, all judged against the same records."""
    ensure_checkpoints(spark)
    records = _records(spark, d)
    good = se.seal(records, "good", "exporter", "2026-01-02T00:00:00Z", FORM).drop("refusal").checkpoint()
    wrong = {"form": ("format", F.lit("other")), "none": ("snapshot_id", F.lit(" ")), "date": ("generated_at", F.lit("yesterday")), "who": ("producer", F.lit("")), "mutable": ("immutable", F.lit(False)), "rootless": ("content_hash_root", F.lit(None).cast("string")),
             "sources": ("source_count", F.col("source_count") + 1), "versions": ("version_count", F.col("version_count") - 1), "root": ("content_hash_root", F.concat(F.lit("sha256:"), F.sha2("content_hash_root", 256)))}
    all_ = good
    for name, (column, value) in wrong.items():
        all_ = all_.unionByName(good.withColumn("snapshot_id", F.lit(name)).withColumn(column, value))
    return se.verdicts(records, all_, FORM)


CHANGED = RECORDS.replace("upper(sha256(html))", "upper(sha256(CASE WHEN page_id % 17 = 3 THEN html || 'x' ELSE html END))")


@query(f"{_root(CHANGED)} SELECT {ROOT_NOW} AS root, count(*) FILTER (CAST(substr(version_id, 2) AS BIGINT) % 17 = 3) AS changed FROM records")
def snapshot_update(spark, d):
    """The root of a changed snapshot from the old tree and the changed leaves alone."""
    ensure_checkpoints(spark)
    old = sequenced(se.leaves_of(_records(spark, d)), ["source_id", "version_id"]).checkpoint()
    new = se.leaves_of(_records(spark, d, changed=True)).withColumnRenamed("hash", "fresh")
    changed = old.join(new, ["source_id", "version_id"]).where("hash <> fresh").select("idx", F.col("fresh").alias("hash")).checkpoint()
    levels = se.updated_levels(merkle_levels(old.select("idx", "hash")), changed)
    return levels[-1].select(F.col("hash").alias("root")).crossJoin(F.broadcast(changed.agg(F.count(F.lit(1)).alias("changed"))))  # one row each


@query("""SELECT 'S' || page_id // 2 || '-V' || page_id AS id, CASE WHEN page_id % 4 = 1 THEN 'export/' || page_id ELSE url END AS path, CASE WHEN page_id % 5 = 2 THEN 'pdf' WHEN page_id % 3 = 0 THEN 'html' ELSE 'markdown' END AS type, 'law' AS domain, 'team' AS owner, 'primary' AS priority, 'active' AS status, 'sha256:' || sha256(html) AS hash,
 'snapshot=snap-1 version_id=v' || page_id || ' captured_at=2026-01-01T00:00:00Z' AS notes, CASE WHEN page_id % 6 = 0 THEN 'excluded' ELSE 'admitted' END AS admission_status, CASE WHEN page_id % 6 = 0 THEN '' ELSE 'not_atomized' END AS atomization_status,
 CASE WHEN page_id % 6 = 0 THEN 'excluded_by_policy: no terms' ELSE 'not_atomized: imported from snapshot snap-1, awaiting the pipeline' END AS exclusion_reason, CASE WHEN page_id % 6 = 0 THEN 'reference' ELSE 'canonical' END AS source_role, 'supported' AS format_support FROM pages""")
def snapshot_import(spark, d):
    k = F.col("page_id")
    rows = _records(spark, d).withColumns({"export_path": F.when(k % 4 == 1, F.concat(F.lit("export/"), k)).otherwise(" "), "source_type": F.when(k % 5 == 2, "pdf").otherwise(""), "web": k % 3 == 0, "web_refusal": F.when(k % 2 == 0, "no terms")})
    return se.imported(rows, "snap-1", "law", "team")


# -- governed terms -------------------------------------------------------------------------------------------------

LEXICON = """lex0 AS (SELECT p_name AS term, p_name AS canonical, 'preferred' AS status FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_type || ' ' || split_part(p_name, ' ', 1), p_name, 'synonym' FROM part WHERE p_partkey % 7 = 0
 UNION ALL SELECT split_part(p_name, ' ', 2), p_name, 'deprecated' FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_name || ' brand', p_name, 'synonym' FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT split_part(p_name, ' ', 2), p_name, 'preferred' FROM part WHERE length(split_part(p_name, ' ', 2)) % 2 = 0)"""


@query(f"""WITH RECURSIVE {LEXICON},
lex AS (SELECT key, min_by(canonical, o) AS canonical, min_by(status, o) AS status FROM (SELECT lower(term) AS key, canonical, status, CASE status WHEN 'preferred' THEN '0' WHEN 'synonym' THEN '1' ELSE '2' END || canonical AS o FROM lex0) GROUP BY key),
t AS (SELECT p_partkey, lower(p_type || ', ' || p_name || ' (' || p_brand || ')') AS text, [lower(p_type), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), 'brand', split_part(p_brand, '#', 2)] AS w FROM part),
s AS (SELECT p_partkey, i, max(n) FILTER (key IS NOT NULL) AS n FROM (SELECT t.p_partkey, i, n, lex.key FROM t, range(1, 6) a(i), range(1, 6) b(n) LEFT JOIN lex ON lex.key = array_to_string(w[i:i + n - 1], ' ') AND i + n <= 6) GROUP BY ALL HAVING true),
m AS (SELECT p_partkey, i, coalesce(max(n), 0) AS n FROM s GROUP BY ALL),
g(p_partkey, i, n) AS (SELECT p_partkey, i, n FROM m WHERE i = 1 UNION ALL SELECT m.p_partkey, m.i, m.n FROM g JOIN m ON m.p_partkey = g.p_partkey AND m.i = g.i + greatest(g.n, 1))
SELECT CAST(g.p_partkey AS VARCHAR) AS source, lex.key AS phrase, lex.canonical, lex.status, CAST(g.i - 1 AS INTEGER) AS word_no, CAST(g.n AS INTEGER) AS words FROM g JOIN t ON t.p_partkey = g.p_partkey JOIN lex ON lex.key = array_to_string(t.w[g.i:g.i + g.n - 1], ' ') WHERE g.n > 0""")
def governed_term_uses(spark, d):
    """Preferred, synonymous and deprecated phrases in the parts' descriptions, longest first."""
    ensure_checkpoints(spark)
    p, k = table(spark, d, "part"), F.col("p_partkey")
    second, name = F.element_at(F.split("p_name", " "), 2), F.col("p_name")
    entry = lambda where, term, status: p.where(where).select(term.alias("term"), name.alias("canonical"), F.lit(status).alias("status"))
    lexicon = entry(k % 3 == 0, name, "preferred").unionByName(entry(k % 7 == 0, F.concat_ws(" ", "p_type", F.substring_index("p_name", " ", 1)), "synonym")).unionByName(entry(k % 5 == 0, second, "deprecated")).unionByName(entry(k % 11 == 0, F.concat(name, F.lit(" brand")), "synonym")).unionByName(entry(F.length(second) % 2 == 0, second, "preferred"))
    docs = p.select(k.alias("source"), F.concat("p_type", F.lit(", "), "p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("text"))
    return lx.term_uses(docs, lexicon).select("source", "phrase", "canonical", "status", "word_no", "words")


# -- nested reports, levels -----------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag, list_sort([l_linestatus, 'e' || l_partkey % 3, 'e' || l_suppkey % 5]) AS evidence FROM lineitem),
r AS (SELECT l_orderkey, list(struct_pack(id := l_linenumber, code := l_returnflag, evidence := evidence) ORDER BY l_linenumber, l_returnflag, evidence) AS findings FROM f GROUP BY ALL)
SELECT l_orderkey AS report, sha256(array_to_string(list_transform(findings, lambda x: x.id || ':' || x.code || ':' || array_to_string(x.evidence, '+')), ';')) AS digest, CAST(2 AS BIGINT) AS copies FROM r""")
def report_digests(spark, d):
    """Each order's findings as a nested report, once in order of line and once reversed, lists within too: both copies have one canonical form."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("code"), F.array("l_linestatus", F.concat(F.lit("e"), F.col("l_partkey") % 3), F.concat(F.lit("e"), F.col("l_suppkey") % 5)).alias("evidence")).alias("f"))
    one = rows.groupBy(F.col("l_orderkey").alias("report")).agg(F.collect_list("f").alias("findings"))
    other = one.select("report", F.reverse(F.transform("findings", lambda x: x.withField("evidence", F.reverse(x["evidence"])))).alias("findings"))
    both = one.unionByName(other)
    form = both.withColumn("findings", canonical(F.col("findings"), both.schema["findings"].dataType))
    flat = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["id"].cast("string"), x["code"], F.array_join(x["evidence"], "+"))), ";")
    return form.groupBy("report", F.sha2(flat, 256).alias("digest")).agg(F.count(F.lit(1)).alias("copies"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s, t FROM (SELECT p_partkey // 3 AS s, p_partkey AS t FROM part UNION ALL SELECT p_partkey - p_size, p_partkey FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT p_partkey + 1, p_partkey FROM part WHERE p_partkey % 97 = 5 UNION ALL SELECT p_partkey - 1, p_partkey FROM part WHERE p_partkey % 97 = 6) WHERE s <> t AND s IN (SELECT p_partkey FROM part)),
c(t) AS (SELECT p_partkey FROM part WHERE p_partkey % 97 = 5 AND EXISTS (SELECT 1 FROM e WHERE e.s = p_partkey + 1 AND e.t = p_partkey) AND EXISTS (SELECT 1 FROM e WHERE e.s = p_partkey AND e.t = p_partkey + 1) UNION SELECT e.t FROM c JOIN e ON e.s = c.t),
w(n, level) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey NOT IN (SELECT t FROM e) UNION SELECT e.t, level + 1 FROM w JOIN e ON e.s = w.n WHERE e.t NOT IN (SELECT t FROM c))
SELECT p_partkey AS node, CAST(max(level) AS INTEGER) AS level FROM part LEFT JOIN w ON w.n = p_partkey AND p_partkey NOT IN (SELECT t FROM c) GROUP BY p_partkey""")
def topological_levels(spark, d):
    """Longest ways from the parts that none leads to; nodes of rings and behind them have no level."""
    ensure_checkpoints(spark)
    p, k = table(spark, d, "part"), F.col("p_partkey")
    edges = p.select(F.floor(k / 3).alias("source"), k.alias("target")).unionByName(p.where(k % 4 == 1).select((k - F.col("p_size")).alias("source"), k.alias("target"))).unionByName(p.where(k % 97 == 5).select((k + 1).alias("source"), k.alias("target")))
    back = p.where(k % 97 == 6).select((k - 1).alias("source"), k.alias("target"))
    nodes = p.select(k.alias("node"))
    edges = edges.unionByName(back).join(nodes.withColumnRenamed("node", "source"), "source", "left_semi")
    return gr.topological_levels(nodes, edges).select("node", F.col("level").cast("int").alias("level"))

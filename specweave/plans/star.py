"""Trace tables derived from the star-schema tables, and the queries over them.

The same rules are written in SQL below, so every query has a twin that another
engine can run on the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from .analysis import Trace, tag_filter


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ITEMS_SQL = """
SELECT 'feat:nation/n' || n_nationkey || '#1' AS id, 'spec' AS origin, CAST(n_nationkey AS BIGINT) AS item_seq, 'nation' AS tag FROM nation
UNION ALL SELECT 'req:orders/o' || o_orderkey || '#' || year(o_orderdate) || '.' || month(o_orderdate), 'spec', CAST(1000000000 + o_orderkey AS BIGINT), o_orderpriority FROM orders
UNION ALL SELECT 'dsn:supplier/s' || s_suppkey || '#1', 'spec', CAST(2000000000 + s_suppkey AS BIGINT), '' FROM supplier
UNION ALL SELECT 'impl:orders/o' || l_orderkey || '/l' || l_linenumber || '#' || (l_suppkey % 3 + 1) || '.' || month(l_shipdate), 'code', CAST(10000000000 + l_orderkey * 100 + l_linenumber * 10 AS BIGINT), '' FROM lineitem
UNION ALL SELECT 'std:part/p' || p_partkey || '#1.' || j, 'spec', CAST(3000000000 + p_partkey * 10 + j AS BIGINT), p_brand FROM part, (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2) k WHERE j <= p_partkey % 3
UNION ALL SELECT 'plan:customer/c' || c_custkey || '#1', 'spec', CAST(4000000000 + c_custkey AS BIGINT), c_mktsegment FROM customer
"""
NEEDS_SQL = """
SELECT CAST(1000000000 + o_orderkey AS BIGINT) AS item_seq, CAST(n AS BIGINT) AS ord,
       'impl:orders/o' || o_orderkey || '/l' || n || '#' || CASE o_orderkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN '1.x' WHEN 2 THEN '2.*' ELSE '3.' || month(o_orderdate) END AS ref
FROM orders, (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) k WHERE n <= o_orderkey % 3 + 1
UNION ALL SELECT CAST(c_nationkey AS BIGINT), CAST(o_orderkey AS BIGINT), 'req:orders/o' || o_orderkey || '#x' FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0
UNION ALL SELECT CAST(3000000000 + p_partkey * 10 + j AS BIGINT), CAST(0 AS BIGINT), 'req:orders/o' || (p_partkey * 7 + j) || '#x' FROM part, (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2) k WHERE j <= p_partkey % 3
UNION ALL SELECT CAST(4000000000 + c_custkey AS BIGINT), CAST(0 AS BIGINT), 'std:part/p' || c_custkey || '#1.x' FROM customer
"""
COVERS_SQL = """
SELECT CAST(1000000000 + o_orderkey AS BIGINT) AS item_seq, CAST(0 AS BIGINT) AS ord, 'feat:nation/n' || (c_nationkey + CASE WHEN o_orderkey % 50 = 0 THEN 100 ELSE 0 END) || '#1.0' AS ref
FROM orders JOIN customer ON o_custkey = c_custkey
"""
FORWARDS_SQL = """
SELECT CAST(s_suppkey * 10 AS BIGINT) AS fwd_seq, s_suppkey AS s, (s_suppkey * 7 + 3) % ((SELECT count(*) FROM supplier) * 13 / 10) AS t FROM supplier
UNION ALL SELECT CAST(s_suppkey * 10 + 1 AS BIGINT), s_suppkey, s_suppkey + 1 FROM supplier WHERE s_suppkey % 10 = 0
UNION ALL SELECT CAST(s_suppkey * 10 + 2 AS BIGINT), s_suppkey + 100000000, s_suppkey FROM supplier WHERE s_suppkey % 25 = 0
"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = F.concat
    n = _t(spark, sf_dir, "nation").select(cat(F.lit("feat:nation/n"), "n_nationkey", F.lit("#1")).alias("id"), F.lit("spec").alias("origin"), F.col("n_nationkey").cast("long").alias("item_seq"), F.lit("nation").alias("tag"))
    o = _t(spark, sf_dir, "orders").select(cat(F.lit("req:orders/o"), "o_orderkey", F.lit("#"), F.year("o_orderdate"), F.lit("."), F.month("o_orderdate")), F.lit("spec"), (F.lit(1000000000) + F.col("o_orderkey")).cast("long"), "o_orderpriority")
    s = _t(spark, sf_dir, "supplier").select(cat(F.lit("dsn:supplier/s"), "s_suppkey", F.lit("#1")), F.lit("spec"), (F.lit(2000000000) + F.col("s_suppkey")).cast("long"), F.lit(""))
    l = _t(spark, sf_dir, "lineitem").select(  # noqa: E741
        cat(F.lit("impl:orders/o"), "l_orderkey", F.lit("/l"), "l_linenumber", F.lit("#"), (F.col("l_suppkey") % 3 + 1), F.lit("."), F.month("l_shipdate")), F.lit("code"),
        (F.lit(10000000000) + F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10).cast("long"), F.lit(""),
    )
    # several revisions of one key, so that wildcard needs have several matches
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", F.explode(F.sequence(F.lit(0), (F.col("p_partkey") % 3).cast("int"))).alias("j"))
    p = p.select(cat(F.lit("std:part/p"), "p_partkey", F.lit("#1."), "j"), F.lit("spec"), (F.lit(3000000000) + F.col("p_partkey") * 10 + F.col("j")).cast("long"), "p_brand")
    c = _t(spark, sf_dir, "customer").select(cat(F.lit("plan:customer/c"), "c_custkey", F.lit("#1")), F.lit("spec"), (F.lit(4000000000) + F.col("c_custkey")).cast("long"), "c_mktsegment")
    out = n.union(o).union(s).union(l).union(p).union(c)
    tags = F.when(F.col("tag") == "", F.array().cast("array<string>")).otherwise(F.array("tag"))
    return out.select("item_seq", "id", "origin", F.lit("star").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("character"), tags.alias("tags"))


def needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    pattern = F.when(k % 4 == 0, "x").when(k % 4 == 1, "1.x").when(k % 4 == 2, "2.*").otherwise(F.concat(F.lit("3."), F.month("o_orderdate")))
    lines = orders.select("o_orderkey", pattern.alias("p"), F.explode(F.sequence(F.lit(1), (k % 3 + 1).cast("int"))).alias("n"))
    a = lines.select((F.lit(1000000000) + k).cast("long").alias("item_seq"), F.col("n").cast("long").alias("ord"), F.concat(F.lit("impl:orders/o"), "o_orderkey", F.lit("/l"), "n", F.lit("#"), "p").alias("ref"))
    b = orders.where(k % 2 == 0).join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("long"), k.cast("long"), F.concat(F.lit("req:orders/o"), "o_orderkey", F.lit("#x")))
    p = _t(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), (F.col("p_partkey") % 3).cast("int"))).alias("j"))
    p = p.select((F.lit(3000000000) + F.col("p_partkey") * 10 + F.col("j")).cast("long"), F.lit(0).cast("long"), F.concat(F.lit("req:orders/o"), F.col("p_partkey") * 7 + F.col("j"), F.lit("#x")))
    c = customer.select((F.lit(4000000000) + F.col("c_custkey")).cast("long"), F.lit(0).cast("long"), F.concat(F.lit("std:part/p"), "c_custkey", F.lit("#1.x")))
    return a.union(b).union(p).union(c)


def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = F.col("c_nationkey") + F.when(F.col("o_orderkey") % 50 == 0, 100).otherwise(0)
    return both.select((F.lit(1000000000) + F.col("o_orderkey")).cast("long").alias("item_seq"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("feat:nation/n"), n, F.lit("#1.0")).alias("ref"))


def forwards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    n = sup.agg((F.count("*") * 13 / 10).alias("n"))
    a = sup.crossJoin(F.broadcast(n)).select((F.col("k") * 10).alias("fwd_seq"), F.col("k").alias("s"), ((F.col("k") * 7 + 3) % F.floor("n")).alias("t"))
    b = sup.where(F.col("k") % 10 == 0).select((F.col("k") * 10 + 1), "k", F.col("k") + 1)
    c = sup.where(F.col("k") % 25 == 0).select((F.col("k") * 10 + 2), F.col("k") + 100000000, "k")
    name = lambda x: F.concat(F.lit("dsn:supplier/s"), x, F.lit("#1"))
    return a.union(b).union(c).select("fwd_seq", name("s").alias("from"), name("t").alias("to"), F.lit("star").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("character"))


def trace(spark: SparkSession, sf_dir: str) -> Trace:
    return Trace(items(spark, sf_dir), needs(spark, sf_dir), covers(spark, sf_dir), forwards(spark, sf_dir))


# ---- queries


def ids_scalar(spark, sf_dir):
    c = F.col("id")
    p = ids.parse_id(c)
    out = items(spark, sf_dir).select("id", p["type"].alias("type"), F.coalesce(p["group"], F.lit("")).alias("grp"), p["name"].alias("name"), p["revision"].alias("revision"), ids.key_of(c).alias("key"), ids.path_of(c).alias("path"), ids.canonical_id(c).alias("canonical_id"))
    return out


def ref_short_forms(spark, sf_dir):
    kind = F.when(F.col("item_seq") % 3 == 0, " `impl` ").when(F.col("item_seq") % 3 == 1, "utest#2.x").otherwise("doc:guide/intro")
    own = items(spark, sf_dir).where("origin = 'spec'")
    return own.select("id", ids.parse_need(kind, F.col("id")).alias("need"), F.coalesce(ids.parse_cover(kind, F.col("id")), F.lit("")).alias("cover"))


def resolve_needs(spark, sf_dir):
    return trace(spark, sf_dir).resolved.select("item_seq", "ord", "ref", "target")


def wanted_by(spark, sf_dir):
    return trace(spark, sf_dir).wanted_by.groupBy("target").agg(F.count("*").alias("n_wanting"))


def revision_hint(spark, sf_dir):
    return trace(spark, sf_dir).revisions.select("key", F.array_join("existing", ", ").alias("existing"))


def _defects(name):
    def query(spark, sf_dir):
        return getattr(trace(spark, sf_dir), name).select("item_seq", "ord", "kind", "ref", "message")

    return query


def forward_states(spark, sf_dir):
    return trace(spark, sf_dir).forwards.select("fwd_seq", "from", "to", F.coalesce("voided_by", F.lit("")).alias("voided_by"), "effective")


def forward_cycles(spark, sf_dir):
    return trace(spark, sf_dir).cycle_nodes.select("c_from")


def missing_sources(spark, sf_dir):
    return trace(spark, sf_dir).missing_sources.select("fwd_seq", "message")


def needed_ids(spark, sf_dir):
    return trace(spark, sf_dir).needed.select("canonical_id")


def deep_coverage(spark, sf_dir):
    return trace(spark, sf_dir).broken.select("node")


def statuses(spark, sf_dir):
    return trace(spark, sf_dir).statuses.select("item_seq", "id", "status")


def summary(spark, sf_dir):
    return trace(spark, sf_dir).summary


def id_make(spark, sf_dir):
    p = ids.parse_id(F.col("id"))
    return items(spark, sf_dir).select("item_seq", "id", ids.make_id(p["type"], p["group"], p["name"], p["revision"]).alias("made"))


def id_matches(spark, sf_dir):
    """Needs held against the item of the same order whose line number and revision they may mean."""
    asked = needs(spark, sf_dir).where("ref like 'impl:%'").select("ref", ids.key_of(F.col("ref")).alias("key"))
    code = items(spark, sf_dir).where("origin = 'code'").select("item_seq", "id", ids.key_of(F.col("id")).alias("key"))
    both = asked.join(code, "key")
    rev = ids.revision_of
    return both.select("ref", "item_seq", ids.id_matches(F.col("ref"), F.col("id")).alias("id_matches"), ids.revision_matches(rev(F.col("ref")), rev(F.col("id"))).alias("rev_matches"))


def nest_resolved_to(spark, sf_dir):
    return trace(spark, sf_dir).resolved_to.select("item_seq", "ord", "ref", F.array_join("resolved_to", ",").alias("resolved_to"))


def nest_wanted_by(spark, sf_dir):
    return trace(spark, sf_dir).wanted_by_lists.select("item_seq", F.array_join(F.transform("wanted_by", lambda x: x["id"]), ",").alias("wanted_by"))


def nest_forwarded_from(spark, sf_dir):
    return trace(spark, sf_dir).forwarded_from.select("item_seq", F.array_join(F.transform("forwarded_from", lambda x: x["id"]), ",").alias("forwarded_from"))


def nest_cover_status(spark, sf_dir):
    return trace(spark, sf_dir).cover_states


def tag_filtered(spark, sf_dir):
    return tag_filter(items(spark, sf_dir), ["1-URGENT", "_"]).select("item_seq", "id")


_CANON = "(k || '#' || CAST(CAST(split_part(r, '.', 1) AS BIGINT) AS VARCHAR) || '.' || coalesce(CAST(TRY_CAST(nullif(split_part(r, '.', 2), '') AS BIGINT) AS VARCHAR), '0') || '.' || coalesce(CAST(TRY_CAST(nullif(split_part(r, '.', 3), '') AS BIGINT) AS VARCHAR), '0'))"


def _canon(c: str) -> str:
    return _CANON.replace("k ||", f"split_part({c}, '#', 1) ||").replace("(r,", f"(split_part({c}, '#', 2),")


BASE_SQL = f"""
WITH RECURSIVE items AS (SELECT *, split_part(id, '#', 1) AS key, split_part(id, '#', 2) AS revision, {_canon('id')} AS canonical_id FROM ({ITEMS_SQL})),
needs AS (SELECT n.*, i.canonical_id AS node FROM ({NEEDS_SQL}) n JOIN items i USING (item_seq)),
covers AS (SELECT c.*, i.canonical_id AS node, i.id, {_canon('c.ref')} AS c_ref FROM ({COVERS_SQL}) c JOIN items i USING (item_seq)),
nodes AS (SELECT canonical_id, key, count(*) AS n FROM items GROUP BY ALL),
resolved AS (SELECT DISTINCT item_seq, ord, node, ref, n2.canonical_id AS target FROM needs JOIN nodes n2 ON split_part(ref, '#', 1) = n2.key
  WHERE starts_with(split_part(n2.canonical_id, '#', 2) || '.', CASE WHEN regexp_matches(split_part(ref, '#', 2), '[x*]') THEN regexp_replace(split_part(ref, '#', 2), '[x*]$', '') ELSE split_part(ref, '#', 2) || '.' END)
    AND (regexp_matches(split_part(ref, '#', 2), '[x*]') OR split_part(n2.canonical_id, '#', 2) = split_part(ref, '#', 2) || '.0')),
revs AS (SELECT key, array_to_string(list(revision ORDER BY CAST(split_part(revision, '.', 1) AS BIGINT), coalesce(TRY_CAST(nullif(split_part(revision, '.', 2), '') AS BIGINT), 0)), ', ') AS existing FROM (SELECT DISTINCT key, revision FROM items) GROUP BY key),
decl AS (SELECT fwd_seq, 'dsn:supplier/s' || s || '#1' AS "from", 'dsn:supplier/s' || CAST(floor(t) AS BIGINT) || '#1' AS "to" FROM ({FORWARDS_SQL})),
fw0 AS (SELECT d.*, "from" || '.0.0' AS c_from, "to" || '.0.0' AS c_to, row_number() OVER (PARTITION BY "from" ORDER BY fwd_seq) AS nth, count(*) OVER (PARTITION BY "from") AS declared, n.canonical_id IS NOT NULL AS known
  FROM decl d LEFT JOIN nodes n ON d."from" || '.0.0' = n.canonical_id),
live AS (SELECT c_from, c_to FROM fw0 WHERE known AND nth = 1),
reach(a, b) AS (SELECT c_from, c_to FROM live UNION SELECT a, c_to FROM reach JOIN live ON b = c_from),
cyc AS (SELECT a AS c_from FROM reach WHERE a = b),
fw AS (SELECT *, CASE WHEN NOT known THEN 'missing-source' WHEN nth > 1 THEN 'duplicate' WHEN c_from IN (SELECT c_from FROM cyc) THEN 'cycle' ELSE '' END AS voided_by FROM fw0),
eff AS (SELECT c_from AS node, "to", c_to FROM fw WHERE voided_by = ''),
needed AS (SELECT target AS canonical_id FROM resolved UNION SELECT c_to FROM eff),
hint AS (SELECT key, ' (revision mismatch: existing revision(s) of ' || key || ': ' || existing || ')' AS h FROM revs),
d_duplicate AS (SELECT item_seq, CAST(0 AS BIGINT) AS ord, 'duplicate-id' AS kind, id AS ref, 'duplicate: ID ' || id || ' is defined ' || n || ' times' AS message FROM items JOIN nodes USING (canonical_id) WHERE n > 1),
d_dupfwd AS (SELECT i.item_seq, CAST(0 AS BIGINT) AS ord, 'duplicate-forwarding' AS kind, "from" AS ref, 'duplicate: forwarding for ' || "from" || ' is declared ' || declared || ' times' AS message FROM fw JOIN items i ON c_from = canonical_id WHERE nth = 1 AND declared > 1),
d_unfwd AS (SELECT i.item_seq, CAST(0 AS BIGINT) AS ord, 'uncovered-forward' AS kind, e."to" AS ref, 'uncovered: forwards to ' || e."to" || ', which does not exist' || coalesce(h, '') AS message
  FROM eff e JOIN items i ON e.node = i.canonical_id LEFT JOIN hint ON split_part(e."to", '#', 1) = hint.key WHERE e.c_to NOT IN (SELECT canonical_id FROM nodes)),
d_unneed AS (SELECT n.item_seq, n.ord, 'uncovered-need' AS kind, n.ref, 'uncovered: needs ' || n.ref || ', which does not exist' || coalesce(h, '') AS message
  FROM needs n LEFT JOIN hint ON split_part(n.ref, '#', 1) = hint.key WHERE n.node NOT IN (SELECT node FROM eff) AND NOT EXISTS (SELECT 1 FROM resolved r WHERE r.item_seq = n.item_seq AND r.ord = n.ord)),
d_orphan AS (SELECT c.item_seq, c.ord, 'orphaned-cover' AS kind, c.ref, 'orphaned: covers ' || c.ref || ', which does not exist' || coalesce(h, '') AS message FROM covers c LEFT JOIN hint ON split_part(c.ref, '#', 1) = hint.key WHERE c_ref NOT IN (SELECT canonical_id FROM nodes)),
d_uncover AS (SELECT c.item_seq, c.ord, 'unwanted-cover' AS kind, c.ref, 'unwanted: covers ' || c.ref || ', but ' || c.ref || ' does not need ' || c.id AS message FROM covers c WHERE c_ref IN (SELECT canonical_id FROM nodes) AND NOT EXISTS (SELECT 1 FROM resolved r WHERE r.node = c.c_ref AND r.target = c.node)),
d_unitem AS (SELECT item_seq, CAST(0 AS BIGINT) AS ord, 'unwanted-item' AS kind, id AS ref, 'unwanted: no item needs ' || id AS message FROM items WHERE origin = 'code' AND canonical_id NOT IN (SELECT canonical_id FROM needed)),
bad AS (SELECT item_seq FROM d_duplicate UNION SELECT item_seq FROM d_dupfwd UNION SELECT item_seq FROM d_unfwd UNION SELECT item_seq FROM d_unneed UNION SELECT item_seq FROM d_orphan UNION SELECT item_seq FROM d_uncover UNION SELECT item_seq FROM d_unitem UNION SELECT item_seq FROM items WHERE canonical_id IN (SELECT c_from FROM cyc)),
ob AS (SELECT n.item_seq, n.ord, n.node, r.target FROM needs n LEFT JOIN resolved r ON r.item_seq = n.item_seq AND r.ord = n.ord WHERE n.node NOT IN (SELECT node FROM eff)),
b0 AS (SELECT DISTINCT node FROM ob WHERE target IS NULL),
b1 AS (SELECT node FROM b0 UNION SELECT node FROM ob WHERE target IS NOT NULL GROUP BY item_seq, ord, node HAVING bool_and(target IN (SELECT node FROM b0))),
b2 AS (SELECT node FROM b1 UNION SELECT node FROM ob WHERE target IS NOT NULL GROUP BY item_seq, ord, node HAVING bool_and(target IN (SELECT node FROM b1))),
b3 AS (SELECT node FROM b2 UNION SELECT node FROM ob WHERE target IS NOT NULL GROUP BY item_seq, ord, node HAVING bool_and(target IN (SELECT node FROM b2))),
bf(node) AS (SELECT i.canonical_id FROM d_unfwd d JOIN items i USING (item_seq) UNION SELECT e.node FROM bf JOIN eff e ON e.c_to = bf.node),
broken AS (SELECT node FROM b3 UNION SELECT node FROM bf),
lab AS (SELECT a AS c_from, min(b) AS root FROM reach WHERE a IN (SELECT c_from FROM cyc) GROUP BY a),
walk(a, place) AS (SELECT c_from, c_from FROM live UNION SELECT a, c_to FROM walk JOIN live ON place = c_from WHERE place NOT IN (SELECT c_from FROM cyc)),
entry AS (SELECT root, arg_min(place, fwd_seq) AS place FROM walk JOIN lab ON place = lab.c_from JOIN fw0 ON fw0.c_from = walk.a AND fw0.nth = 1 GROUP BY root),
ring(root, start, place, i) AS (SELECT root, place, place, 0 FROM entry UNION ALL SELECT root, start, c_to, i + 1 FROM ring JOIN live ON place = c_from WHERE c_to <> start),
chain AS (SELECT ring.root, string_agg("from", ' --> ' ORDER BY i) || ' --> ' || arg_min("from", i) AS text FROM ring JOIN fw0 ON fw0.c_from = ring.place AND nth = 1 GROUP BY ring.root),
d_cyclic AS (SELECT i.item_seq, CAST(0 AS BIGINT) AS ord, 'cyclic-forwarding' AS kind, fw."to" AS ref, 'cyclic: forwards to ' || fw."to" || ', closing the cycle ' || chain.text || ', so the forwarding has no effect' AS message
  FROM fw JOIN lab USING (c_from) JOIN chain USING (root) JOIN items i ON i.canonical_id = fw.c_from WHERE voided_by = 'cycle'),
st AS (SELECT item_seq, id, origin, item_seq IN (SELECT item_seq FROM bad) AS defective, canonical_id NOT IN (SELECT node FROM broken) AS deep FROM items)
"""


def _sql(select: str) -> str:
    return BASE_SQL + select


_D = "SELECT item_seq, ord, kind, ref, message FROM "
SQL = {
    "ids_scalar": _sql("SELECT id, split_part(id, ':', 1) AS type, regexp_extract(id, ':(?:(.*)/)?([^/]+)#', 1) AS grp, regexp_extract(id, ':(?:(.*)/)?([^/]+)#', 2) AS name, revision, key, regexp_extract(id, ':(.*)#', 1) AS path, canonical_id FROM items"),
    "ref_short_forms": _sql("SELECT id, CASE item_seq % 3 WHEN 0 THEN 'impl:' || regexp_extract(id, ':(.*)#', 1) || '#' || revision WHEN 1 THEN 'utest:' || regexp_extract(id, ':(.*)#', 1) || '#2.x' ELSE 'doc:guide/intro#' || revision END AS need, CASE item_seq % 3 WHEN 0 THEN 'impl:' || regexp_extract(id, ':(.*)#', 1) || '#' || revision WHEN 1 THEN '' ELSE 'doc:guide/intro#' || revision END AS cover FROM items WHERE origin = 'spec'"),
    "resolve_needs": _sql("SELECT item_seq, ord, ref, target FROM resolved"),
    "wanted_by": _sql("SELECT target, count(*) AS n_wanting FROM (SELECT DISTINCT target, item_seq FROM resolved) GROUP BY target"),
    "revision_hint": _sql("SELECT key, existing FROM revs"),
    "duplicate_id": _sql(_D + "d_duplicate"),
    "duplicate_forwarding": _sql(_D + "d_dupfwd"),
    "cyclic_forwarding": _sql(_D + "d_cyclic"),
    "uncovered_forward": _sql(_D + "d_unfwd"),
    "uncovered_need": _sql(_D + "d_unneed"),
    "orphaned_cover": _sql(_D + "d_orphan"),
    "unwanted_cover": _sql(_D + "d_uncover"),
    "unwanted_item": _sql(_D + "d_unitem"),
    "forward_states": _sql('SELECT fwd_seq, "from", "to", voided_by, voided_by = \'\' AS effective FROM fw'),
    "forward_cycles": _sql("SELECT c_from FROM cyc"),
    "missing_sources": _sql("SELECT fwd_seq, 'forwarding from ' || \"from\" || ', which does not exist' || coalesce(h, '') AS message FROM fw LEFT JOIN hint ON split_part(\"from\", '#', 1) = hint.key WHERE voided_by = 'missing-source'"),
    "needed_ids": _sql("SELECT canonical_id FROM needed"),
    "deep_coverage": _sql("SELECT node FROM broken"),
    "statuses": _sql("SELECT item_seq, id, CASE WHEN defective THEN 'defective' WHEN deep THEN 'deep-covered' ELSE 'shallow-covered' END AS status FROM st"),
    "summary": _sql("SELECT count(*) AS items, count_if(origin = 'spec') AS spec_items, count_if(origin = 'code') AS code_items, count_if(NOT defective) AS ok_items, count_if(defective) AS defective_items, count_if(NOT defective AND NOT deep) AS shallow_covered_items, (SELECT count(*) FROM fw WHERE voided_by = 'missing-source') AS problems FROM st"),
    "id_make": _sql("SELECT item_seq, id, id AS made FROM items"),
    "id_matches": _sql("SELECT ref, i.item_seq, m AS id_matches, m AS rev_matches FROM (SELECT ref, i.item_seq, CASE WHEN regexp_matches(split_part(ref, '#', 2), '[x*]') THEN starts_with(split_part(i.id, '#', 2) || '.', regexp_replace(split_part(ref, '#', 2), '[x*]$', '')) ELSE split_part(i.canonical_id, '#', 2) = split_part(ref, '#', 2) || '.0' END AS m FROM needs n JOIN items i ON split_part(ref, '#', 1) = i.key WHERE ref LIKE 'impl:%') i"),
    "nest_resolved_to": _sql("SELECT n.item_seq, n.ord, n.ref, coalesce(r.l, '') AS resolved_to FROM needs n LEFT JOIN (SELECT r.item_seq, r.ord, string_agg(i.id, ',' ORDER BY CAST(split_part(split_part(i.canonical_id, '#', 2), '.', 1) AS INT), CAST(split_part(split_part(i.canonical_id, '#', 2), '.', 2) AS INT)) AS l FROM resolved r JOIN (SELECT DISTINCT canonical_id, id FROM items) i ON r.target = i.canonical_id GROUP BY ALL) r ON n.item_seq = r.item_seq AND n.ord = r.ord"),
    "nest_wanted_by": _sql("SELECT i.item_seq, string_agg(w.id, ',' ORDER BY w.item_seq) AS wanted_by FROM (SELECT DISTINCT target, item_seq FROM resolved) r JOIN items i ON i.canonical_id = r.target JOIN items w ON w.item_seq = r.item_seq GROUP BY i.item_seq"),
    "nest_forwarded_from": _sql("SELECT i.item_seq, string_agg(w.id, ',' ORDER BY w.item_seq) AS forwarded_from FROM eff JOIN items i ON i.canonical_id = eff.c_to JOIN items w ON w.canonical_id = eff.node GROUP BY i.item_seq"),
    "nest_cover_status": _sql("SELECT item_seq, ord, ref, CASE WHEN c_ref NOT IN (SELECT canonical_id FROM nodes) THEN 'orphaned' WHEN EXISTS (SELECT 1 FROM resolved r WHERE r.node = c_ref AND r.target = covers.node) THEN 'valid' ELSE 'unwanted' END AS status FROM covers"),
    "tag_filter": _sql("SELECT item_seq, id FROM items WHERE origin = 'code' OR tag IN ('1-URGENT', '')"),
}
QUERIES = {
    "ids_scalar": ids_scalar, "ref_short_forms": ref_short_forms, "resolve_needs": resolve_needs, "wanted_by": wanted_by, "revision_hint": revision_hint,
    "duplicate_id": _defects("duplicates"), "duplicate_forwarding": _defects("duplicate_forwardings"), "cyclic_forwarding": _defects("cyclic"), "uncovered_forward": _defects("uncovered_forwards"),
    "uncovered_need": _defects("uncovered_needs"), "orphaned_cover": _defects("orphaned_covers"), "unwanted_cover": _defects("unwanted_covers"), "unwanted_item": _defects("unwanted_items"),
    "forward_states": forward_states, "forward_cycles": forward_cycles, "missing_sources": missing_sources, "needed_ids": needed_ids, "deep_coverage": deep_coverage, "statuses": statuses,
    "summary": summary, "tag_filter": tag_filtered, "id_make": id_make, "id_matches": id_matches, "nest_resolved_to": nest_resolved_to, "nest_wanted_by": nest_wanted_by,
    "nest_forwarded_from": nest_forwarded_from, "nest_cover_status": nest_cover_status,
}

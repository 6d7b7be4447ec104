"""Queries of filters, joins, windows, limits, ledgers and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import address
from ..functions.numbers import js_round
from ..operators import graph as G
from ..operators import relational as R
from ..operators.corpus import same_rows
from ..sources import tables as S
from ..sources.tables import table
from .bindings import CREATORS, EDGES, SIGHTINGS, creators, edges, sightings, sql
from .registry import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.query
c = F.col


@query(sql(CREATORS, query="SELECT * FROM creators WHERE status IN ('CONFIRMED', 'REVIEW') AND lower(trim(country)) NOT IN ('nation_3', 'nation_7')"))
def q04_operator_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = spark.createDataFrame([("  Nation_3 ",), ("NATION_7",)], "country string")
    return R.operator_visible(creators(spark, sf_dir), excluded, ["CONFIRMED", "REVIEW"])


@query(sql(CREATORS, query="SELECT *, creator_id % 2 = 0 AS assigned FROM creators WHERE (creator_id % 2 = 0 AND quality >= 50) OR (NOT creator_id % 2 = 0 AND status = 'CONFIRMED')"))
def q04b_serving_canary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = creators(spark, sf_dir).withColumn("assigned", c("creator_id") % 2 == 0)
    return rows.where(R.serving_scope("CANARY", c("assigned"), c("quality") >= 50, c("status") == "CONFIRMED"))


@query(sql(CREATORS, query="SELECT creator_id, quality FROM creators WHERE NOT coalesce(nullif(quality, 0) >= 50, false)"))
def q04c_diagnostics_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return creators(spark, sf_dir).where(R.complement(F.nullif("quality", F.lit(0)) >= 50)).select("creator_id", "quality")


@query(sql(CREATORS, query="SELECT *, (SELECT count(*) FROM creators WHERE status = 'CONFIRMED' AND (name ILIKE '%9%' OR country ILIKE '%9%')) AS total FROM creators WHERE status = 'CONFIRMED' AND (name ILIKE '%9%' OR country ILIKE '%9%') ORDER BY quality DESC, creator_id LIMIT 25 OFFSET 25"))
def q05_listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = creators(spark, sf_dir).withColumn("audience", F.lit("PROCEED"))
    return R.page(rows.where(R.listing_filter(status="CONFIRMED", region="ALL", search="9", columns=("name", "country"))).drop("audience"), [F.desc("quality"), F.asc("creator_id")], 2, 25)


@query(sql(SIGHTINGS, CREATORS, query="SELECT creator_id, country, ts, outcome, event_id FROM (SELECT * FROM sightings QUALIFY row_number() OVER (PARTITION BY creator_id ORDER BY ts DESC, event_id DESC) = 1) JOIN creators USING (creator_id)"))
def q06_latest_per_creator(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = R.latest(sightings(spark, sf_dir), ["creator_id"], [F.desc("ts"), F.desc("event_id")])
    return last.join(creators(spark, sf_dir).select("creator_id", "country"), "creator_id").select("creator_id", "country", "ts", "outcome", "event_id")


ASOF = "l AS (SELECT event_id, user_id % 40 AS k, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS rid, user_id % 40 AS k, ts AS rts, value FROM events WHERE event_type IN ('view', 'signup'))"


@query(sql(ASOF, query="SELECT event_id, k, ts, (SELECT arg_max(value, (rts, rid)) FROM r WHERE r.k = l.k AND rts <= l.ts) AS asof_value FROM l"))
def q07_asof_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", c("user_id") % 40)
    left = e.where("event_type = 'purchase'").select("event_id", "k", "ts")
    right = e.where("event_type IN ('view', 'signup')").select("k", "value", c("ts").alias("rts"), c("event_id").alias("rid"))
    return R.asof_backward(left, right, "k", "ts", "rts", "value", "rid")


@query(sql(ASOF, query="SELECT event_id, k, ts, (SELECT arg_min(value, (rts, value)) FROM r WHERE r.k = l.k AND rts >= l.ts AND rts < TIMESTAMP '2024-01-25') AS next_value FROM l"))
def q07b_asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", c("user_id") % 40)
    left = e.where("event_type = 'purchase'").select("event_id", "k", "ts")
    right = e.where("event_type IN ('view', 'signup')").select("k", "value", c("ts").alias("rts"))
    return R.asof_forward(left, right, "k", "ts", "rts", "2024-01-25", "value")


@query("""SELECT p_partkey, p_brand FROM part WHERE lower(p_name) NOT IN (SELECT DISTINCT lower(p_name) FROM part WHERE p_partkey % 50 = 0) ORDER BY p_partkey""")
def q07c_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", c("p_name").alias("text"))
    runs = p.where("p_partkey % 50 = 0").select(F.upper("text").alias("text"), F.lit("2024-01-01 10:00:00").cast("timestamp").alias("ran_at"))
    old = p.limit(0).select("text").withColumn("ran_at", F.lit("2023-01-01").cast("timestamp"))
    return R.cooled_down(p, runs.unionByName(old), "2024-01-01 12:00:00").select("p_partkey", "p_brand")


@query("""WITH u AS (SELECT p_brand, count(*) AS n FROM part WHERE p_size % 7 = 0 GROUP BY 1) SELECT p_partkey, p_brand FROM part LEFT JOIN u USING (p_brand) WHERE coalesce(n, 0) < 12""")
def q07d_repeat_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", c("p_brand").alias("primary_term"))
    return R.limit_repeats(p, p.where("p_size % 7 = 0"), 12).select("p_partkey", "p_brand")


@query("""SELECT p_partkey, p_type AS intent FROM part WHERE p_type <> (SELECT arg_max(p_type, p_partkey) FROM part WHERE p_size = 10)""")
def q07e_rotate_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", c("p_type").alias("intent"), "p_size")
    runs = p.where("p_size = 10").select("intent", c("p_partkey").alias("ran_at"), c("p_partkey").alias("run_id"))
    return R.rotate_intent(p, runs).select("p_partkey", "intent")


@query("""SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'view' THEN 2 ELSE -1 END DESC, event_id DESC) = 1""")
def q25_outcome_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return R.by_precedence(e, ["user_id"], "event_type", {"purchase": 4, "signup": 3, "view": 2}, "event_id")


@query("""WITH u AS (SELECT regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^(www|m)\\.', '') AS host, regexp_extract(url, '\\.([a-z]+)', 1) AS part, url, page_id FROM pages)
SELECT host, array_to_string(list_sort(list_distinct(list(part))), ',') AS parts, count(*) AS observations, max(page_id) AS page_id FROM u GROUP BY host""")
def q25b_link_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    host = F.regexp_replace(F.regexp_extract("url", r"^https?://([^/?#]+)", 1), r"^(www|m)\.", "")
    rows = p.select(host.alias("host"), F.array(F.regexp_extract("url", r"\.([a-z]+)", 1)).alias("parts"), "page_id")
    return R.merge_observations(rows, "host", ["parts"], "page_id").withColumn("parts", F.array_join("parts", ","))


@query("""SELECT doc_id, first_value(doc_id) OVER w AS keeper_id, first_value(doc_id) OVER w = doc_id AS is_keeper FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id)""")
def q56_ledger_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return R.keepers(d, ["h"], [F.asc("doc_id")], "doc_id").drop("h")


@query("""SELECT event_id, event_type, value FROM events WHERE event_id % 3 <> 0""")
def q56b_idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return S.insert_new(e.where("event_id % 3 = 0"), e.unionByName(e.where("event_id % 2 = 0")), ["event_id"], [F.asc("value")])


@query("""WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS best, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT c_custkey AS k, c_acctbal AS best, 0 AS n, c_mktsegment AS segment FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(t.k, o.k) AS k, greatest(coalesce(t.best, o.best), coalesce(o.best, t.best)) AS best, coalesce(o.n, t.n) AS n, coalesce(t.segment, CASE WHEN o.k IS NOT NULL THEN 'NEW' END) AS segment FROM t FULL JOIN o ON t.k = o.k""")
def q57_upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("best"), F.count("*").alias("n")).withColumn("segment", F.lit("NEW"))
    t = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(c("c_custkey").alias("k"), c("c_acctbal").alias("best"), F.lit(0).cast("long").alias("n"), c("c_mktsegment").alias("segment"))
    return S.upsert(t, o, ["k"], {"best": "greatest", "segment": "coalesce"})


@query("""SELECT user_id, sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS total, count(*) FILTER (CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 0) AS even, max(json_extract_string(props, '$.k')) AS top FROM events GROUP BY user_id""")
def q58_json_payload_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M18, M19, J14, J15."""
    e = table(spark, sf_dir, "events").select("user_id", F.from_json("props", "k int").alias("p"), F.get_json_object("props", "$.k").alias("text"))
    return e.groupBy("user_id").agg(F.sum("p.k").alias("total"), F.count_if(c("p.k") % 2 == 0).alias("even"), F.max("text").alias("top"))


@query("SELECT min(s) AS free_slot FROM (SELECT unnest(range(1, 101)) AS s) WHERE s NOT IN (SELECT DISTINCT user_id % 90 + 1 FROM events WHERE user_id % 90 <> 17)")
def q59_gap_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "events").where("user_id % 90 <> 17").select((c("user_id") % 90 + 1).alias("slot"))
    return R.first_free_slot(used, 100)


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT *, o_orderdate + to_days(CAST(5 + o_orderkey % 20 AS INTEGER)) AS e FROM orders)) WHERE o_orderdate < reach""")
def q60_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("e", c("o_orderdate") + F.make_dt_interval((5 + c("o_orderkey") % 20).cast("int")))
    return R.overlaps(o, "o_custkey", "o_orderdate", "e", "o_orderkey").select("o_orderkey", "o_custkey")


@query("""SELECT c_custkey, rule FROM customer JOIN (SELECT 'BUILDING' AS segment, 'own' AS rule UNION ALL SELECT 'MACHINERY', 'own') r ON segment = c_mktsegment UNION ALL SELECT c_custkey, 'all' FROM customer""")
def q60b_scoped_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("BUILDING", "own"), ("MACHINERY", "own"), (None, "all")], "scope string, rule string")
    return R.scoped(table(spark, sf_dir, "customer").withColumn("scope", c("c_mktsegment")), rules, "scope").select("c_custkey", "rule")


@query("""WITH a AS (SELECT event_id, 1 AS queue FROM (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 40)), b AS (SELECT event_id, 2 AS queue FROM (SELECT * FROM events WHERE event_id NOT IN (SELECT event_id FROM a) ORDER BY user_id, event_id LIMIT 40)) SELECT * FROM a UNION ALL SELECT * FROM b""")
def q60c_disjoint_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return R.disjoint_queues(e, [F.desc("value"), F.asc("event_id")], 40, [F.asc("user_id"), F.asc("event_id")], 40, "event_id").select("event_id", "queue")


@query("""SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS place FROM events QUALIFY place <= 5""")
def q60d_sample_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.per_key(table(spark, sf_dir, "events"), ["event_type"], [F.desc("ts"), F.asc("event_id")], 5).select("event_id", "event_type", "place")


@query("""SELECT event_id FROM (SELECT *, user_id % 97 = 0 AS manual, epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(ts) >= 2000 AS starved FROM events WHERE event_type = 'error') ORDER BY manual DESC, starved DESC, value DESC, event_id LIMIT 1""")
def q60e_next_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", (c("user_id") % 97 == 0).alias("manual"), c("ts").alias("enqueued_at"), c("value").alias("priority"), c("event_id").alias("sequence"))
    return R.next_request(e, "2024-01-31").select("event_id")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision, CASE WHEN value > 50 THEN sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS choice FROM events""")
def q60f_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W06, W11."""
    e = S.numbered_by_key(table(spark, sf_dir, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")])
    return e.select("event_id", "revision", R.running_choice(c("value") > 50, Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("choice"))


@query("""WITH runs AS (SELECT event_type, event_id // 100 AS run, avg(value) AS a FROM events GROUP BY 1, 2) SELECT event_type, run, floor(a * 100 + 0.5) / 100 AS now, round((sum(a) OVER (PARTITION BY event_type) - a) / nullif(count(*) OVER (PARTITION BY event_type) - 1, 0), 6) AS others FROM runs""")
def q60g_average_of_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    runs = table(spark, sf_dir, "events").groupBy("event_type", F.floor(c("event_id") / 100).alias("run")).agg(F.avg("value").alias("a"))
    w = Window.partitionBy("event_type")
    return runs.select("event_type", "run", js_round("a", 2).alias("now"), F.round((F.sum("a").over(w) - c("a")) / F.nullif(F.count("*").over(w) - 1, F.lit(0)), 6).alias("others"))


@query("""SELECT 'left' AS side, c_custkey FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'right', c_custkey FROM customer WHERE c_custkey % 15 = 7 AND c_custkey % 10 <> 0""")
def q60h_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "customer").select("c_custkey")
    return same_rows(k.where("c_custkey % 15 <> 7 OR c_custkey % 10 = 0"), k.where("c_custkey % 10 <> 0"))


@query("""SELECT 'unique(event_id)' AS "check", 0 AS violations UNION ALL SELECT 'not_null(ts)', 0 UNION ALL SELECT 'not_null(value)', count(*) FILTER (value IS NULL) FROM events""")
def q60i_data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.data_quality(table(spark, sf_dir, "events"), ["event_id"], ["ts", "value"])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'DELETED' WHEN o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 700 DAY THEN 'EXPIRED' ELSE 'RETAINED' END AS disposition, CASE WHEN o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 700 DAY THEN o_orderpriority END AS excerpt FROM orders""")
def q60j_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", c("o_orderdate").alias("observed_at"), (c("o_orderstatus") == "F").alias("deleted"), c("o_orderpriority").alias("excerpt"))
    return S.retention(o, "2001-08-01", 700).select("o_orderkey", "disposition", "excerpt")


@query("""SELECT e.event_id AS observation_key, e.ts < TIMESTAMP '2024-01-30' - INTERVAL 15 MINUTE AS stale FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'view' AND d.event_id = e.event_id AND d.event_id % 4 = 0)""")
def q60k_outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'view'").select(c("event_id").alias("observation_key"), c("ts").alias("created_at"))
    return S.outbox_pending(e, e.where("observation_key % 4 = 0"), "2024-01-30").select("observation_key", "stale")


ACTIVE = """active AS (SELECT * FROM (SELECT * FROM edges WHERE valid_from <= TIMESTAMP '2000-06-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2000-06-01') AND coalesce(observed_at, valid_from) <= TIMESTAMP '2000-06-01'
  QUALIFY row_number() OVER (PARTITION BY from_id, to_id, family ORDER BY observed_at DESC, edge_id) = 1) WHERE assertion = 'ASSERTED')"""


@query(sql(EDGES, ACTIVE, query="SELECT * FROM active"))
def q47_active_edges_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.active_edges(edges(spark, sf_dir), "2000-06-01")


FRONTIER = """two AS (SELECT from_id, to_id, family, confidence_bp, valid_from FROM active UNION ALL SELECT to_id, from_id, family, confidence_bp, valid_from FROM active),
good AS (SELECT two.*, count(*) OVER (PARTITION BY from_id) AS degree FROM two WHERE confidence_bp >= 8400),
plain AS (SELECT from_id, to_id, count(DISTINCT family) AS families, max(confidence_bp) AS confidence, max(valid_from) AS newest FROM good WHERE degree <= 100 GROUP BY 1, 2),
hubs AS (SELECT from_id, to_id, row_number() OVER (PARTITION BY from_id ORDER BY confidence_bp DESC, to_id) AS place FROM good WHERE degree > 100),
arcs AS (SELECT from_id, to_id, families, confidence, newest, place, false AS hub FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY to_id) AS place FROM plain) WHERE place <= 10 UNION ALL SELECT from_id, to_id, 1, NULL, NULL, min(place), true FROM hubs WHERE place <= 10 GROUP BY 1, 2),
start AS (SELECT DISTINCT from_id FROM two WHERE from_id IN ('S1', 'S2', 'S3') OR regexp_full_match(from_id, 'P[1-9][0-9]?')),
way1 AS (SELECT arcs.*, 1 AS depth, [from_id, to_id] AS path FROM arcs WHERE from_id IN (FROM start) AND to_id NOT IN (FROM start)),
first1 AS (SELECT *, row_number() OVER (ORDER BY path, place) AS found FROM (SELECT * FROM way1 QUALIFY row_number() OVER (PARTITION BY to_id ORDER BY path, place) = 1)),
state1 AS (SELECT *, CASE WHEN hub THEN 'HUB_CAPPED' WHEN newest < TIMESTAMP '2000-06-01' - INTERVAL 800 DAY THEN 'STALE' WHEN families < 1 THEN 'INSUFFICIENT_INDEPENDENCE' WHEN found > 50 THEN 'COMPONENT_CAPPED' ELSE 'ELIGIBLE' END AS disposition FROM first1),
way2 AS (SELECT arcs.*, 2 AS depth, list_append(s.path, arcs.to_id) AS path FROM arcs JOIN state1 s ON arcs.from_id = s.to_id WHERE s.disposition = 'ELIGIBLE' AND arcs.to_id NOT IN (FROM start)),
first2 AS (SELECT *, (SELECT count(*) FROM first1) + row_number() OVER (ORDER BY path, place) AS found FROM (SELECT * FROM way2 WHERE to_id NOT IN (SELECT to_id FROM first1) QUALIFY row_number() OVER (PARTITION BY to_id ORDER BY path, place) = 1)),
state2 AS (SELECT *, CASE WHEN hub THEN 'HUB_CAPPED' WHEN newest < TIMESTAMP '2000-06-01' - INTERVAL 800 DAY THEN 'STALE' WHEN families < 1 THEN 'INSUFFICIENT_INDEPENDENCE' WHEN found > 50 THEN 'COMPONENT_CAPPED' ELSE 'ELIGIBLE' END AS disposition FROM first2),
lasthub AS (SELECT * FROM (SELECT * FROM way1 UNION ALL SELECT * FROM way2) WHERE hub QUALIFY row_number() OVER (PARTITION BY to_id ORDER BY depth DESC, path DESC, place DESC) = 1)"""


@query(sql(EDGES, ACTIVE, FRONTIER, query="""SELECT to_id AS entity_id, coalesce(h.from_id, s.from_id) AS parent_id, coalesce(h.depth, s.depth) AS depth, array_to_string(coalesce(h.path, s.path), '>') AS path, CASE WHEN h.to_id IS NULL THEN s.families ELSE 1 END AS families, CASE WHEN h.to_id IS NULL THEN disposition ELSE 'HUB_CAPPED' END AS disposition,
CAST(CASE WHEN h.to_id IS NULL AND disposition = 'ELIGIBLE' THEN floor(s.confidence / CAST(s.depth AS DOUBLE) + 0.5) ELSE 0 END AS BIGINT) AS score FROM (SELECT * FROM state1 UNION ALL SELECT * FROM state2) s LEFT JOIN lasthub h USING (to_id)"""))
def q48_bounded_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = G.active_edges(edges(spark, sf_dir), "2000-06-01")
    two = a.unionByName(a.withColumns({"from_id": c("to_id"), "to_id": c("from_id")}))
    seeds = two.where("from_id IN ('S1', 'S2', 'S3') OR from_id RLIKE '^P[1-9][0-9]?$'").select(c("from_id").alias("entity_id"))
    return G.bounded_frontier(seeds, two, "2000-06-01", least_bp=8400, component=50, fresh_days=800)


@query("""WITH RECURSIVE links AS (SELECT n_nationkey // 2 AS parent, n_nationkey AS child FROM nation WHERE n_nationkey > 0), paths AS (SELECT parent AS ancestor, child AS descendant, 1 AS depth FROM links UNION ALL SELECT ancestor, child, depth + 1 FROM paths JOIN links ON parent = descendant WHERE depth < 8)
SELECT ancestor, descendant, min(depth) AS depth FROM paths GROUP BY 1, 2""")
def q49_lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where("n_nationkey > 0")
    return G.closure(n.select(F.floor(c("n_nationkey") / 2).alias("parent"), c("n_nationkey").cast("long").alias("child")))


@query("SELECT 0 AS node UNION ALL SELECT 1 UNION ALL SELECT 2")
def q49b_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.when(c("n_nationkey") < 3, (c("n_nationkey") + 1) % 3).otherwise(F.floor(c("n_nationkey") / 2)).cast("long").alias("parent"), c("n_nationkey").cast("long").alias("child"))
    return G.cyclic(n)


@query("""SELECT c_custkey, CASE WHEN n = 1 THEN p END AS parent, CASE WHEN n = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS resolution FROM customer LEFT JOIN (SELECT s_nationkey AS k, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS p FROM supplier WHERE s_suppkey % 4 = 1 GROUP BY 1) ON k = c_nationkey""")
def q49c_lineage_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 1").select(c("s_nationkey").alias("k"), c("s_suppkey").alias("parent"))
    return G.resolve_lineage(table(spark, sf_dir, "customer").select("c_custkey", c("c_nationkey").alias("k")), parents, "k").select("c_custkey", "parent", "resolution")


SEAL = " || ".join(f"coalesce(CAST({x} AS VARCHAR), chr(0)) || chr(31)" for x in ("assertion", "confidence_bp", "edge_id", "family", "from_id", "observed_at", "to_id", "valid_from", "valid_until"))


@query(sql(EDGES, ACTIVE, query=f"SELECT family, count(*) AS rows, CAST(sum(h) AS VARCHAR) AS digest, bit_xor(h) AS parity FROM (SELECT family, CAST('0x' || substr(sha256({SEAL}), 1, 15) AS BIGINT) AS h FROM active) GROUP BY 1"))
def q49d_sealed_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sealed(G.active_edges(edges(spark, sf_dir), "2000-06-01"), ["family"])


URLS = r"""found AS (SELECT page_id, list_distinct(list_filter(list_transform(regexp_extract_all(replace(html, '&amp;', '&'), 'https?://[^\s"''<>)\\]+'), lambda u: regexp_replace(u, '[.,);:><"]+$', '')), lambda u: NOT regexp_matches(u, '(?i)\.(png|jpg|jpeg|gif|webp|svg|css|js|wasm|ico|woff|woff2|ttf|eot)(\?.*)?$'))) AS urls FROM (SELECT page_id, html || ' ' || url AS html FROM pages))"""


@query(sql(URLS, query=r"""SELECT page_id, u AS url, CASE WHEN regexp_extract(u, '^https?://([^/?#]+)', 1) <> '' THEN 'https://' || lower(regexp_extract(u, '^https?://([^/?#]+)', 1)) || regexp_replace(regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1), '/$', '') END AS plain FROM (SELECT page_id, unnest(urls) AS u FROM found)"""))
def q24_url_extract_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", "html", "url").alias("t"))
    found = p.select("page_id", F.explode(address.extract("t")).alias("url"))
    return found.select("page_id", "url", address.plain("url").alias("plain"))


@query(r"""SELECT page_id, 'EXTERNAL_EVIDENCE' AS kind, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) || CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END AS identity FROM pages""")
def q24b_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", address.locator("url", "video.example").alias("l")).select("page_id", "l.kind", "l.identity")


@query(r"""SELECT page_id, CASE WHEN host LIKE '%.%' THEN scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS normal FROM (SELECT page_id, lower(regexp_extract(url, '^(https?)://', 1)) AS scheme, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/$', '') AS path, array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda kv: kv <> '' AND NOT regexp_matches(kv, '(?i)^(utm_[^=]*|fbclid|gclid|ref|feature)(=|$)')), '&') AS q FROM pages)""")
def q24c_full_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T18, T19. The pages' addresses need neither decoding nor IDN, which tests cover."""
    return table(spark, sf_dir, "pages").select("page_id", address.normalized("url", wrappers=("redirect.example",)).alias("normal"))

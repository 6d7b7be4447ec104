"""Queries of decision rules: each is held against the rule as SQL states it, over whole tables.

The tables have no such entities, so each row of orders, customers or events stands for one: its inputs are derived from its
columns by expressions that mean the same in both dialects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address, days, numbers, text
from ..operators import allocation as L
from ..operators import lifecycle as D
from ..sources.tables import table
from .registry import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.query
c = F.col


@dataclass(frozen=True)
class Rows:
    """Rows x of a table, with columns by expressions."""

    source: str
    columns: tuple[str, ...]

    def sql(self, query: str) -> str:
        return f"WITH x AS (SELECT {', '.join(self.columns)} FROM {self.source})\n{query}"

    def load(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, self.source).selectExpr(*self.columns)


def pick(of: str, *values: str) -> str:
    """An expression for one of the values by what `of` leaves, null for NULL."""
    plain = all(v.isdigit() or v in ("NULL", "TRUE", "FALSE") for v in values)
    own = [v if plain or v == "NULL" else repr(v) for v in values]
    return "CASE " + " ".join(f"WHEN ({of}) % {len(own)} = {k} THEN {v}" for k, v in enumerate(own)) + " END"


O = "o_orderkey"

FAILED = Rows("orders", (f"{O} AS id", f"{pick(O, 'FAILED', 'FAILED_PERMANENT', 'COMPLETED', 'FAILED')} AS status", f"{pick('o_custkey', 'COMPLETED', 'RETRY_PENDING', 'NULL')} AS validation", f"{O} % 7 = 0 AS manual", "o_custkey % 4 - 2 AS new_links", f"{pick('o_custkey', 'VERY_ACTIVE', 'ACTIVE', 'DORMANT', 'OCCASIONAL', 'DORMANT')} AS activity", f"CASE WHEN {O} % 11 > 0 THEN {O} % 60 END AS age_days"))


@query(FAILED.sql("""SELECT id, reactivate, CASE WHEN kind IS NOT NULL THEN kind WHEN why = '' THEN 'NO_REACTIVATION_TRIGGER_MATCHED' ELSE why END AS reasons FROM (
SELECT id, kind, why, kind IS NULL AND why <> '' AS reactivate FROM (SELECT id, CASE WHEN status NOT IN ('FAILED', 'FAILED_PERMANENT') THEN 'SCAN_STATUS_NOT_RECOVERABLE_FAILURE' WHEN status = 'FAILED_PERMANENT' AND validation = 'COMPLETED' THEN 'SEMANTIC_TERMINAL_EVIDENCE_PRESERVED' END AS kind,
concat_ws(',', CASE WHEN manual THEN 'OPERATOR_NOMINATED_RECHECK' END, CASE WHEN new_links > 0 THEN 'NEWLY_OBSERVED_EXTERNAL_LINKS' END, CASE WHEN activity IN ('VERY_ACTIVE', 'ACTIVE') THEN 'HIGH_CREATOR_ACTIVITY' END, CASE WHEN age_days >= 30 THEN 'COMMUNITY_FRESHNESS_INTERVAL_EXPIRED' WHEN age_days IS NULL THEN 'NO_PRIOR_CHECK_TIMESTAMP' END) AS why FROM x))"""))
def p19_reactivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FAILED.load(spark, sf_dir).select("id", D.reactivation().alias("r")).select("id", "r.reactivate", F.array_join("r.reasons", ",").alias("reasons"))


TERMS = Rows("orders", (f"{O} AS id", f"{pick('o_custkey', 'instrument', 'METHOD', 'Market', 'TOPIC', 'CONCEPT', 'OTHER', 'BROKER')} AS kind", f"{O} % 3 > 0 AS governed", f"{O} % 5 > 0 AS proven", f"{O} % 4 > 0 AS validated", f"{O} % 6 AS sources"))


@query(TERMS.sql("""SELECT id, CASE WHEN kind IN ('instrument', 'BROKER', 'METHOD') THEN CASE WHEN governed THEN 'STANDALONE' ELSE 'MODIFIER_ONLY' END WHEN kind IN ('Market', 'TOPIC') THEN 'MODIFIER_ONLY' WHEN kind = 'CONCEPT' AND governed AND proven AND validated AND sources >= 2 THEN 'STANDALONE' ELSE 'INELIGIBLE' END AS eligibility,
CASE WHEN kind IN ('instrument', 'BROKER') THEN CASE WHEN governed THEN 95 ELSE 62 END WHEN kind = 'METHOD' THEN CASE WHEN governed THEN 82 ELSE 58 END WHEN kind = 'Market' THEN 42 WHEN kind = 'TOPIC' THEN 45 WHEN kind = 'CONCEPT' AND governed AND proven AND validated AND sources >= 2 THEN 80 ELSE 20 END AS specificity,
CASE WHEN kind IN ('instrument', 'BROKER') THEN CASE WHEN governed THEN 5 ELSE 48 END WHEN kind = 'METHOD' THEN CASE WHEN governed THEN 18 ELSE 52 END WHEN kind = 'Market' THEN 72 WHEN kind = 'TOPIC' THEN 65 WHEN kind = 'CONCEPT' AND governed AND proven AND validated AND sources >= 2 THEN 20 ELSE 80 END AS ambiguity FROM x"""))
def p22_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TERMS.load(spark, sf_dir).select("id", D.specificity().alias("s")).select("id", "s.*")


MERGES = "o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'SPLIT' WHEN o_orderkey % 2 = 0 THEN 'MERGED' ELSE 'CORRECTION' END AS kind, o_custkey % 400 AS source, CASE WHEN o_orderkey % 9 > 0 THEN (o_custkey * 7 + o_orderkey) % 400 END AS target, (o_custkey * 3) % 400 AS split_from"


@query(f"""WITH RECURSIVE ev AS (SELECT {MERGES} FROM orders WHERE o_orderstatus = 'P'), walk(concept, canonical, seq) AS (
  SELECT c_custkey % 400, c_custkey % 400, CAST(-1 AS BIGINT) FROM (SELECT DISTINCT c_custkey % 400 AS c_custkey FROM customer)
  UNION ALL
  SELECT concept, target, s FROM (SELECT w.concept, e.target, e.seq AS s, row_number() OVER (PARTITION BY w.concept ORDER BY e.seq) AS n FROM walk w JOIN ev e ON e.seq > w.seq AND e.target IS NOT NULL AND CASE WHEN e.kind = 'SPLIT' THEN e.split_from = w.canonical AND e.target = w.concept ELSE e.source = w.canonical END) WHERE n = 1)
SELECT concept, arg_max(canonical, seq) AS canonical FROM walk GROUP BY concept""")
def d24_concept_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").selectExpr("o_orderkey AS seq", "CASE WHEN o_orderkey % 5 = 0 THEN 'SPLIT' WHEN o_orderkey % 2 = 0 THEN 'MERGED' ELSE 'CORRECTION' END AS kind", "o_custkey % 400 AS source", "CASE WHEN o_orderkey % 9 > 0 THEN (o_custkey * 7 + o_orderkey) % 400 END AS target", "(o_custkey * 3) % 400 AS split_from")
    return D.project_concept(table(spark, sf_dir, "customer").select((c("c_custkey") % 400).alias("concept")).distinct(), events)


STATES = Rows("orders", (f"{O} AS id", f"{pick(O, 'ADMITTED_CONFIRMED', 'ADMITTED_REVIEW', 'WITHHELD_INVESTIGATING', 'NOT_EVALUATED', 'LEGACY_VISIBLE', 'WITHHELD_SPAM', 'NULL')} AS state"))


@query(STATES.sql("""SELECT id, CASE state WHEN 'ADMITTED_CONFIRMED' THEN 'CONFIRMED' WHEN 'ADMITTED_REVIEW' THEN 'REVIEW' WHEN 'WITHHELD_INVESTIGATING' THEN 'INVESTIGATING' WHEN 'NOT_EVALUATED' THEN 'DISCOVERY_CANDIDATES' WHEN 'LEGACY_VISIBLE' THEN 'DISCOVERY_CANDIDATES' ELSE 'WITHHELD' END AS corpus,
CASE state WHEN 'ADMITTED_CONFIRMED' THEN 'CONFIRMED_CORPUS' WHEN 'ADMITTED_REVIEW' THEN 'REVIEW_CORPUS' WHEN 'WITHHELD_INVESTIGATING' THEN 'INVESTIGATION_IN_PROGRESS' WHEN 'NOT_EVALUATED' THEN 'CANDIDATE_NOT_ADMITTED' WHEN 'LEGACY_VISIBLE' THEN 'CANDIDATE_NOT_ADMITTED' ELSE 'WITHHELD_BY_ADMISSION_POLICY' END AS reason FROM x"""))
def d30_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STATES.load(spark, sf_dir).select("id", D.corpus_of(c("state")).alias("d")).select("id", "d.*")


GATED = Rows("orders", (f"{O} AS id", f"{pick(O, 'PROVEN', 'EXPERIMENTAL', 'REJECTED', 'PROVEN', 'PROVEN', 'PROVEN', 'PROVEN')} AS collection", f"o_custkey % 9 > 0 AS shaped", f"CASE WHEN {O} % 11 > 0 THEN CASE WHEN {O} % 8 = 0 THEN 'v1' ELSE 'v2' END END AS policy", "'v2' AS current_policy", f"{pick('o_custkey', 'STANDALONE', 'ANCHOR_ONLY', 'MODIFIER_ONLY', 'STANDALONE', 'STANDALONE')} AS eligibility", f"{O} % 3 AS atoms", f"CASE WHEN {O} % 13 = 0 THEN 1 ELSE 0 END AS stale_atoms", f"{pick('o_custkey', 'STANDALONE', 'ANCHOR_ONLY', 'ANCHOR_ONLY', 'MODIFIER_ONLY')} AS anchor", f"{pick(O, 'SINGLE_ATOM', 'ORGANIC_STANDALONE', 'PAIR', 'SINGLE_ATOM', 'NULL')} AS template", f"{pick('o_custkey', 'METHOD', 'market', 'NULL')} AS primary_type", f"{O} % 4 = 0 AS explicit"))


@query(GATED.sql("""SELECT id, CASE WHEN collection = 'REJECTED' THEN 'QUERY_ALREADY_REJECTED' WHEN NOT shaped THEN 'CURRENT_RETRIEVAL_SHAPE_FAILED' WHEN policy IS NULL THEN 'CURRENT_RETRIEVAL_PROVENANCE_MISSING' WHEN policy <> current_policy THEN 'STALE_RETRIEVAL_POLICY_VERSION'
WHEN eligibility NOT IN ('STANDALONE', 'ANCHOR_ONLY') THEN 'PRIMARY_ATOM_NOT_AUTHORIZED_FOR_RETRIEVAL' WHEN atoms > 0 AND stale_atoms > 0 THEN 'ATOM_POLICY_PROVENANCE_STALE' WHEN atoms > 0 AND anchor NOT IN ('STANDALONE', 'ANCHOR_ONLY') THEN 'QUERY_ANCHOR_NOT_CURRENTLY_AUTHORIZED'
WHEN atoms > 0 AND template = 'SINGLE_ATOM' AND primary_type = 'METHOD' AND NOT explicit THEN 'STANDALONE_METHOD_REQUIRES_CONCRETE_TRADING_ANCHOR' WHEN atoms = 0 AND coalesce(template, '') NOT IN ('SINGLE_ATOM', 'ORGANIC_STANDALONE') THEN 'COMPOUND_QUERY_ATOM_PROVENANCE_MISSING' ELSE 'CURRENT_RETRIEVAL_POLICY_SATISFIED' END AS reason FROM x"""))
def d35_query_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GATED.load(spark, sf_dir).select("id", D.query_authority().alias("reason"))


CALLS = Rows("orders", (f"{O} AS id", f"{pick(O, 'Error', 'Error', 'AbortError', 'Error', 'Error', 'NULL', 'Error')} AS name", f"CAST({pick('o_custkey', '429', '503', '404', '400', '401', '200', 'NULL', '422', '403')} AS INT) AS status", f"{pick(O, 'plain', 'Quota gone', 'read ECONNRESET', 'model in high demand', 'NULL', 'error 429', 'request blocked', 'Navigation has failed', 'x1429y', 'captcha shown')} AS message"))


@query(CALLS.sql("""SELECT id, CASE WHEN name = 'AbortError' THEN 'CANCELLED' WHEN status = 429 OR regexp_matches(message, '(?i)429|RESOURCE_EXHAUSTED|rate.?limit|quota') THEN 'RATE_LIMIT' WHEN status IN (408, 500, 502, 503, 504) OR regexp_matches(message, '(?i)ECONNRESET|ETIMEDOUT|high demand|temporar') THEN 'TRANSIENT' WHEN status IN (400, 404, 422) THEN 'PERMANENT_INPUT' ELSE 'TRANSIENT' END AS class,
NOT coalesce(coalesce(name, '') <> 'AbortError' AND status IN (400, 404, 422) AND NOT coalesce(regexp_matches(message, '(?i)429|RESOURCE_EXHAUSTED|rate.?limit|quota|ECONNRESET|ETIMEDOUT|high demand|temporar'), FALSE), FALSE) AS retryable FROM x"""))
def d36_provider_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CALLS.load(spark, sf_dir).select("id", D.provider_error(c("name"), c("status"), c("message")).alias("e")).select("id", "e.*")


@query(CALLS.sql(r"""SELECT id, kind, CASE kind WHEN 'RATE_LIMITED' THEN least(8000.0, 1000 * 2.0 ^ (id % 6)) WHEN 'OTHER' THEN NULL ELSE least(4000.0, 500 * 2.0 ^ (id % 6)) END AS delay FROM (SELECT id, CASE WHEN status = 429 OR regexp_matches(message, '(?i)\b429\b|too many requests|rate.?limit') THEN 'RATE_LIMITED' WHEN status IN (401, 403) OR regexp_matches(message, '(?i)\b403\b|\b401\b|request blocked|access denied|forbidden|captcha|bot protection|cloudflare') THEN 'BLOCKED'
WHEN status IN (408, 425, 500, 502, 503, 504) OR regexp_matches(message, '(?i)timeout|timed out|econnreset|econnrefused|eai_again|enotfound|network|navigation.*failed|browser.*closed|target.*closed') THEN 'TRANSIENT' ELSE 'OTHER' END AS kind FROM x)"""))
def d46_crawler_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = CALLS.load(spark, sf_dir).select("id", D.crawler_failure(c("status"), c("message")).alias("kind"))
    return own.withColumn("delay", D.crawler_delay(c("kind"), c("id") % 6))


JOBS = Rows("orders", (f"{O} AS id", f"{pick(O, 'PENDING', 'PENDING', 'RUNNING', 'DONE', 'PENDING', 'PENDING', 'PENDING')} AS status", f"{pick('o_custkey', 'w1', 'NULL', 'NULL', 'NULL')} AS locked_by", f"CASE WHEN {O} % 3 > 0 THEN o_orderdate END AS locked_at", f"{pick('o_custkey', 'ACTIVE', 'COMPLETED', 'NULL')} AS investigation", "o_orderdate AS deadline_at", f"{pick(O, 'RETRYING', 'READY', 'RETRYING')} AS step", f"{pick('o_custkey', 'provider timeout', 'bad schema', 'NULL', 'HTTP 503')} AS failure", "o_orderdate AS run_after", f"{O} % 5 > 0 AS runnable", "DATE '1996-01-01' AS now"))


@query(JOBS.sql("""SELECT id, CASE WHEN status = 'RUNNING' OR (locked_by IS NOT NULL AND locked_at IS NOT NULL) THEN 'ACTIVE_LEASE' WHEN investigation = 'ACTIVE' AND deadline_at <= now THEN 'INVESTIGATION_DEADLINE_RISK' WHEN step = 'RETRYING' AND failure IN ('provider timeout', 'HTTP 503') THEN 'OPERATIONAL_RETRY' WHEN status = 'PENDING' AND run_after > now THEN 'PROVIDER_BACKOFF' WHEN status = 'PENDING' AND runnable THEN 'RUNNABLE_WAITING' ELSE 'UNKNOWN' END AS diagnosis FROM x"""))
def d39_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JOBS.load(spark, sf_dir).select("id", D.backlog_diagnosis().alias("diagnosis"))


DOUBT = Rows("orders", (f"{O} AS id", f"{O} % 4 > 0 AS wants_review", "o_custkey % 3 > 0 AS authority", f"{pick(O, 'ELIGIBLE', 'WAITING', 'NULL')} AS status", f"{pick('o_custkey', 'HUMAN_AMBIGUITY', 'PROVIDER')} AS family"))


@query(DOUBT.sql("""SELECT id, CASE WHEN ask THEN 'NEEDS_REVIEW' ELSE 'ENRICHMENT_PENDING' END AS scan_status, CASE WHEN ask THEN 'NEEDS_REVIEW' ELSE 'UNCERTAIN' END AS trading_status, NOT ask AS enqueue FROM (SELECT id, wants_review AND authority AND coalesce(status = 'ELIGIBLE', FALSE) AND family = 'HUMAN_AMBIGUITY' AS ask FROM x)"""))
def d37_uncertain_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DOUBT.load(spark, sf_dir).select("id", D.uncertain_lifecycle().alias("d")).select("id", "d.*")


ACTIVE = Rows("orders", (f"{O} AS id", f"CASE WHEN {O} % 13 > 0 THEN {O} % 140 - 20 END AS score", f"CASE WHEN o_custkey % 7 > 0 THEN o_custkey % 500 END AS d"))


@query(ACTIVE.sql("""SELECT id, band, CASE band WHEN 'HIGH' THEN 14 WHEN 'MEDIUM' THEN 30 ELSE 90 END AS recheck_days, CASE band WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 5 ELSE 0 END AS priority FROM (SELECT id, CASE WHEN s >= 70 AND d <= 90 THEN 'HIGH' WHEN s >= 35 AND d <= 365 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM (SELECT id, d, least(100, greatest(0, coalesce(score, 50))) AS s FROM x))"""))
def d43_vitality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ACTIVE.load(spark, sf_dir).select("id", D.vitality(c("score"), c("d")).alias("v")).select("id", "v.*")


@query(ACTIVE.sql("SELECT id, CASE WHEN r <= 49 THEN 35 WHEN r <= 64 THEN 50 WHEN r <= 79 THEN 64 WHEN r <= 89 THEN 75 ELSE 84 END AS confidence FROM (SELECT id, least(100, greatest(0, coalesce(score, 0))) AS r FROM x)"))
def d41_semantic_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ACTIVE.load(spark, sf_dir).select("id", D.semantic_confidence(c("score")).alias("confidence"))


MATCHES = Rows("lineitem", ("l_orderkey AS id", "CASE WHEN l_linenumber = 1 THEN l_suppkey % 3 ELSE l_orderkey % 3 END AS entity", "l_returnflag AS family", "CASE WHEN l_linenumber % 4 > 0 THEN l_suppkey % 5 END AS source", "l_quantity > 15 AS approved", "l_orderkey % 4 = 0 AS native"))


@query(MATCHES.sql("""SELECT id, families, sources, CASE WHEN entities > 1 THEN 'ABSTAIN_CONFLICT' WHEN native AND entities = 1 THEN 'EXACT_NATIVE' WHEN entities = 1 AND families >= 2 AND sources >= 2 THEN 'PROPOSE_LINK' ELSE 'ABSTAIN_INSUFFICIENT' END AS disposition, CASE WHEN entities = 1 THEN entity END AS entity
FROM (SELECT id, count(DISTINCT entity) FILTER (approved) AS entities, count(DISTINCT family) AS families, count(DISTINCT source) AS sources, min(entity) FILTER (approved) AS entity, bool_or(native) AS native FROM x GROUP BY id)"""))
def d20_entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.resolution(MATCHES.load(spark, sf_dir), "id")


GAPS = Rows("orders", (f"{O} AS id", f"{pick(O, 'CHANNEL_METADATA_MISSING', 'INDEPENDENCE_MISSING', 'RECENT_DOCUMENT_COVERAGE_INSUFFICIENT', 'TEMPORAL_COVERAGE_INSUFFICIENT', 'QUOTA_DEFERRED', 'REVIEW_JUDGMENT_REQUIRED', 'IDENTITY_UNRESOLVED')} AS g1", f"{pick('o_custkey', 'TRADING_HYPOTHESIS_AMBIGUOUS', 'INDEPENDENCE_MISSING', 'LANGUAGE_UNSUPPORTED')} AS g2", f"{O} % 5 * 40 AS provider_left", "o_custkey % 4 * 60 AS case_left", f"{O} % 6 * 1000 AS milliseconds_left", f"{O} % 2 AS review_left"))
GAP_SQL = " UNION ALL ".join(f"SELECT {n!r} AS action, {list(g)!r} AS closes, {p} AS provider, {r} AS review, {t} AS took" for n, g, p, r, t, ok in D.GAP_ACTIONS if ok)


@query(GAPS.sql(f"""SELECT id, action, score FROM x LEFT JOIN (SELECT id, arg_min(action, (-score, action)) AS action, max(score) AS score FROM (SELECT id, action, round(23.3 - 0.025 * provider - 25 * review - 0.0002 * took, 6) AS score FROM x, ({GAP_SQL}) WHERE list_has_any([g1, g2], closes) AND provider_left >= provider AND case_left >= provider AND milliseconds_left >= took AND review_left >= review) GROUP BY id) USING (id)"""))
def d42_gap_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GAPS.load(spark, sf_dir).withColumn("gaps", F.array("g1", "g2")).select("id", D.gap_action().alias("a")).select("id", "a.*")


QUEUE = Rows("orders", (f"{O} AS id", f"{O} % 20 - 2 AS batch", "o_custkey % 50 AS target_depth", f"{O} % 60 AS depth", f"{O} % 5 - 1 AS n_keys", f"{pick('o_custkey', '0', '5000', '10000')} AS per_key", f"{O} % 160 - 30 AS percent"))


@query(QUEUE.sql("SELECT id, least(greatest(0, batch), greatest(0, target_depth - depth)) AS room, greatest(0, n_keys) * CASE WHEN per_key > 0 THEN per_key ELSE 10000 END AS budget, CAST(floor(greatest(0, n_keys) * CASE WHEN per_key > 0 THEN per_key ELSE 10000 END * least(100, greatest(0, percent)) / 100) AS BIGINT) AS share FROM x"))
def m21_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M21, L28."""
    budget = L.daily_budget(c("n_keys"), c("per_key"))
    return QUEUE.load(spark, sf_dir).select("id", numbers.capacity("batch", "target_depth", "depth").alias("room"), budget.alias("budget"), L.budget_share(budget, c("percent")).alias("share"))


PROGRAMS = Rows("orders", (f"{O} AS id", f"{O} % 9 AS provider_left", "o_custkey % 8 AS daily_left", f"{pick(O, 'ACTIVE', 'SLEEPING', 'COMPLETE', 'ACTIVE', 'SLEEPING', 'ACTIVE', 'DRAFT')} AS lifecycle", f"{pick('o_custkey', 'UNEXPLORED', 'OBSERVED', 'SLEEPING', 'PARTIALLY_OBSERVED', 'OBSERVED')} AS frontier", f"{O} % 10 / 10.0 AS uncertainty", f"CASE WHEN {O} % 3 > 0 THEN o_custkey % 14 * ({O} % 2) END AS unexplored", "o_custkey % 15 / 10.0 AS yield_rate", f"{O} % 7 / 7.0 AS confidence"))


@query(PROGRAMS.sql("""SELECT id, CASE WHEN provider_left <= 0 OR daily_left <= 0 OR lifecycle IN ('COMPLETE', 'SATURATED', 'PAUSED', 'DRAFT') THEN 'STOP' WHEN lifecycle = 'SLEEPING' THEN CASE WHEN frontier IN ('UNEXPLORED', 'PARTIALLY_OBSERVED', 'UNKNOWN') AND uncertainty >= 0.5 THEN 'REACTIVATE' ELSE 'SLEEP' END
WHEN frontier = 'SLEEPING' OR (frontier = 'OBSERVED' AND uncertainty < 0.2 AND coalesce(unexplored = 0, FALSE)) THEN 'SLEEP' ELSE 'ACTIVE' END AS lifecycle, floor((0.4::DOUBLE * uncertainty + 0.25::DOUBLE * coalesce(least(1.0::DOUBLE, unexplored / 10.0::DOUBLE), uncertainty) + 0.15::DOUBLE * (1 - least(1.0::DOUBLE, yield_rate)) + 0.2::DOUBLE * confidence) * 1000000 + 0.5) / 1000000 AS priority FROM x"""))
def l13_program_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L13, L26."""
    x = PROGRAMS.load(spark, sf_dir)
    x = x.withColumns({n: c(n).cast("double") for n in ("uncertainty", "yield_rate", "confidence")})
    return x.select("id", L.program_lifecycle().alias("lifecycle"), L.program_priority().alias("priority"))


CELLS = Rows("customer", ("c_custkey AS cell", "c_custkey % 5 > 0 AS reachable", f"{pick('c_custkey', 'ACTIVE', 'ACTIVE', 'SLEEPING')} AS lifecycle", "CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 200 END AS days_since_probe", "CASE WHEN c_custkey % 7 > 0 THEN CAST(c_custkey % 9 - 1 AS DOUBLE) END AS estimated_unseen", "CAST(c_custkey % 11 AS DOUBLE) / 16 AS marginal_yield", "CAST(c_custkey % 13 AS DOUBLE) / 16 AS uncertainty"))


@query(CELLS.sql("""SELECT cell, 'coverage:' || cell AS cluster_key, greatest(0, coalesce(estimated_unseen, uncertainty)) * greatest(CAST(0.05 AS DOUBLE), marginal_yield) AS incremental, uncertainty AS information, uncertainty + least(1, coalesce(days_since_probe, 365) / 90) AS coverage, CASE WHEN coalesce(days_since_probe, 365) >= 90 THEN 10 ELSE 3 END AS priority FROM x WHERE reachable AND lifecycle = 'ACTIVE'"""))
def l16_coverage_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.coverage_gap_actions(CELLS.load(spark, sf_dir))


SURFACES = Rows("orders", (f"{O} AS id", "o_custkey % 50 AS concept", f"{pick(O, 'Price  Action', 'order flow', 'NEU', 'alt ', 'x y')} AS surface", "o_custkey % 4 AS families", f"{pick(O, 'SUPPORTED', 'PARTIAL', 'ABSTAIN')} AS capability"))


@query(SURFACES.sql("SELECT id, concept, surface FROM x WHERE families >= 2 AND capability <> 'ABSTAIN' AND lower(trim(regexp_replace(surface, '\\s+', ' ', 'g'))) NOT IN ('order flow', 'alt')"))
def l17_cross_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("Order Flow",), ("alt",)], "surface string")
    return L.cross_language(SURFACES.load(spark, sf_dir), known).select("id", "concept", "surface")


CREATORS = Rows("customer", ("c_custkey AS creator_id", "CAST(c_custkey % 9 AS DOUBLE) / 8 AS uncertainty", "CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 16 AS DOUBLE) END AS unexplored", "CAST(c_custkey % 5 AS DOUBLE) / 4 AS confidence", "c_custkey % 2 = 0 AS unresolved"))
NON_QUERY_SQL = " UNION ALL ".join(f"SELECT {n!r} AS action, {v}::DOUBLE AS v, {g}::DOUBLE AS g, {i}::DOUBLE AS i, {k} AS cost, {r}::DOUBLE AS review" for n, v, g, i, k, r in L.NON_QUERY)


@query(CREATORS.sql(f"""SELECT creator_id, action, v * confidence AS incremental, g * greatest(uncertainty, coalesce(least(1, unexplored / 10), 0)) AS coverage, i * uncertainty AS information, least(uncertainty, i * uncertainty * confidence) AS reduction, greatest(0, least(1, confidence * (1 - CAST(0.25 AS DOUBLE) * uncertainty))) AS confidence, cost, review FROM x, ({NON_QUERY_SQL}) WHERE unresolved OR action <> 'RESOLVE_EXTERNAL_ENTITY'"""))
def l23_non_query_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.propose_actions(CREATORS.load(spark, sf_dir))


ACTIONS = Rows("orders", (f"{O} AS id", f"CAST({O} % 5 AS DOUBLE) AS depth", "CAST(o_custkey % 4 AS INT) AS families", *(f"CAST(({O} * {k}) % 17 AS DOUBLE) / 16 AS {n}" for k, n in ((3, "incremental"), (5, "information"), (7, "coverage"), (11, "uncertainty"), (13, "overlap"))), f"CASE WHEN {O} % 3 > 0 THEN CAST({O} % 9 - 2 AS DOUBLE) END AS freshness", "CAST(o_custkey % 200 AS DOUBLE) AS provider_cost", f"CAST({O} % 2 AS DOUBLE) AS review_cost"))
WEIGHTS = {"incremental": 4.0, "information": 2.0, "coverage": 2.0, "uncertainty": 1.0, "freshness": 0.5, "provider_cost": 0.125, "review_cost": 0.5, "overlap": 2.0, "risk": 1.0}


@query(ACTIONS.sql("""SELECT id, round(4 * incremental + 2 * information + 2 * coverage + uncertainty + greatest(0, coalesce(freshness, 0)) / 2 - provider_cost / 8 - review_cost / 2 - 2 * overlap - least(1, depth / 3 + CASE WHEN families < 2 THEN CAST(0.3 AS DOUBLE) ELSE 0 END), 6) AS utility,
round(floor((4 * incremental + 2 * coverage + 2 * information + uncertainty - CAST(0.01 AS DOUBLE) * provider_cost - review_cost / 2) * 1000000 + 0.5) / 1000000, 6) AS planned, CASE WHEN review_cost = 1 THEN NULL ELSE round(2 * incremental + coverage - overlap, 6) END AS bounded, round((incremental + coverage) / greatest(1, provider_cost), 9) AS frontier FROM x"""))
def m15_utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13, M14, M15."""
    planned = numbers.planner_utility("incremental", "coverage", "information", "uncertainty", "provider_cost", "review_cost")
    bounded = numbers.utility({"incremental": 2.0, "coverage": 1.0}, {"overlap": 1.0}, [c("review_cost") == 1])
    return ACTIONS.load(spark, sf_dir).select("id", F.round(numbers.action_utility(WEIGHTS), 6).alias("utility"), F.round(planned, 6).alias("planned"), F.round(bounded, 6).alias("bounded"), F.round(numbers.frontier_score(["incremental", "coverage"], "provider_cost"), 9).alias("frontier"))


FRONTIER = Rows("orders", (f"{O} AS id", f"{O} % 500 AS days", "o_custkey % 12 AS uploads", f"{O} % 3 AS evidence", f"CAST({O} % 5 AS DOUBLE) / 4 AS authority", "CAST(o_custkey % 3 AS DOUBLE) / 2 AS community", f"CAST({O} % 9 AS DOUBLE) / 8 AS uncertainty", f"{pick(O, 'HUMAN_ACCEPTED', 'ADMITTED', 'UNRESOLVED', 'WITHHELD', 'HUMAN_REJECTED', 'OTHER')} AS outcome", "o_custkey % 2 = 0 AS randomized", f"CASE WHEN {O} % 4 > 0 THEN CAST({O} % 7 AS DOUBLE) / 5 END AS propensity"))


@query(FRONTIER.sql("""SELECT id, score, CASE WHEN score >= 0.65 THEN 'PRIORITIZE' WHEN score >= 0.3 THEN 'EXPLORE' ELSE 'DEFER' END AS disposition, reward, eligible FROM (SELECT id, floor((0.25::DOUBLE * CASE WHEN days <= 30 THEN 1 WHEN days <= 90 THEN 0.75 WHEN days <= 180 THEN 0.4 WHEN days <= 365 THEN 0.15 ELSE 0 END::DOUBLE + 0.2::DOUBLE * least(1, uploads / 8) + 0.25::DOUBLE * CASE WHEN evidence >= 2 THEN 1 WHEN evidence >= 1 THEN 0.45 ELSE 0 END::DOUBLE + 0.1::DOUBLE * authority + 0.1::DOUBLE * community + 0.1::DOUBLE * uncertainty) * 10000 + 0.5) / 10000 AS score,
CASE outcome WHEN 'HUMAN_ACCEPTED' THEN 1 WHEN 'ADMITTED' THEN 0.6 WHEN 'WITHHELD' THEN -0.35 WHEN 'HUMAN_REJECTED' THEN -1 ELSE 0 END::DOUBLE AS reward, coalesce(randomized OR (propensity > 0 AND propensity <= 1), FALSE) AS eligible FROM x)"""))
def m16_creator_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M16, M17."""
    f = numbers.creator_frontier("days", "uploads", "evidence", "authority", "community", "uncertainty")
    return FRONTIER.load(spark, sf_dir).select("id", f.alias("f"), numbers.outcome_reward("outcome", "randomized", "propensity").alias("o")).select("id", "f.*", "o.*")


REVIEWS = Rows("orders", (f"{O} AS id", *(f"({O} * {k}) % {m} = 0 AS {n}" for k, m, n in ((3, 11, "country_rejected"), (5, 13, "terminal"), (7, 9, "operational_failure"), (2, 7, "investigating"), (1, 5, "degraded"), (1, 3, "provider_failed"))), "o_custkey % 4 AS documents", f"{O} % 2 = 0 AS retrieved", "o_custkey % 3 > 0 AS semantic", f"{O} % 4 AS families", f"CAST({O} % 10 AS DOUBLE) / 10 AS score", "CAST(0.5 AS DOUBLE) AS threshold"))


@query(REVIEWS.sql("""SELECT id, CASE WHEN country_rejected THEN 'COUNTRY' WHEN terminal THEN 'TERMINAL' WHEN operational_failure THEN 'OPERATIONAL' WHEN investigating THEN 'INVESTIGATING' WHEN degraded THEN 'DEGRADED' WHEN documents < 1 THEN 'NO_EVIDENCE' ELSE 'ELIGIBLE' END AS review,
CASE WHEN NOT retrieved THEN 'RETRIEVAL' WHEN provider_failed THEN 'PROVIDER' WHEN documents < 1 THEN 'EVIDENCE' WHEN NOT semantic THEN 'SEMANTIC' WHEN families < 2 THEN 'CORROBORATION' WHEN score < threshold THEN 'SCORE' ELSE 'POLICY' END AS lost FROM x"""))
def d29_review_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D29, D34."""
    return REVIEWS.load(spark, sf_dir).select("id", D.review_eligibility().alias("review"), D.false_negative().alias("lost"))


OFFLINE = Rows("orders", (f"{O} AS id", f"{O} % 14 AS documents", "o_custkey % 5 AS families", f"{O} % 7 > 0 AS recent", "o_custkey % 9 > 0 AS supported", f"CAST({O} % 11 AS DOUBLE) / 10 AS alternative", "CAST(o_custkey % 11 AS DOUBLE) / 10 AS lower", f"CAST(({O} * 3) % 50 AS DOUBLE) / 50 AS trade", f"{pick(O, 'CONFIRMED', 'NON_TRADING', 'UNKNOWN')} AS label", f"{O} % 2 = 0 AS degraded"))


@query(OFFLINE.sql("""SELECT id, a AS admission, CASE WHEN a = 'DEFER' AND degraded AND documents >= 10 AND families >= 3 AND supported AND recent AND trade < 0.05 THEN 'WITHHOLD' ELSE a END AS under_pressure FROM (SELECT *, CASE WHEN documents < 2 OR families < 2 OR NOT recent OR NOT supported THEN 'DEFER' WHEN alternative >= 0.8 AND trade < 0.2 AND label = 'NON_TRADING' THEN 'WITHHOLD' WHEN lower >= 0.7 AND trade >= 0.7 AND alternative < 0.6 AND label = 'CONFIRMED' THEN 'ADMIT' WHEN trade >= 0.35 THEN 'REVIEW' WHEN degraded AND documents >= 10 AND families >= 3 AND trade < 0.05 THEN 'WITHHOLD' ELSE 'DEFER' END AS a FROM x)"""))
def d14_offline_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14, D27."""
    own = OFFLINE.load(spark, sf_dir).withColumn("admission", D.admission())
    return own.select("id", "admission", D.rate_pressure(c("admission"), c("degraded"), c("documents"), c("families"), c("supported"), c("recent"), c("trade")).alias("under_pressure"))


SLEEPS = Rows("orders", (f"{O} AS id", f"{O} % 3 > 0 AS observed", "CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 4 > 0 END AS exhausted", f"CAST({O} % 10 AS DOUBLE) / 100 AS marginal_yield", "CAST(o_custkey % 10 AS DOUBLE) / 10 AS upper_bound", "CAST(0.55 AS DOUBLE) AS threshold", f"{O} % 7 = 0 AS probe_due", f"{pick(O, 'PRODUCTIVE', 'HARMFUL', 'UNKNOWN')} AS state", "o_custkey % 6 = 0 AS saturating", f"CAST({O} % 10 AS DOUBLE) / 10 AS dup"))


@query(SLEEPS.sql("""SELECT id, observed AND coalesce(exhausted, FALSE) AND marginal_yield < 0.05 AND upper_bound < threshold AND NOT probe_due AS sleeps, state <> 'HARMFUL' AND NOT saturating AS eligible, CASE WHEN state = 'HARMFUL' OR saturating OR dup >= 0.7 THEN 1 ELSE 3 END AS depth, state <> 'HARMFUL' AND NOT saturating AS date_allowed FROM x"""))
def d17_sleep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D17, P17."""
    own = SLEEPS.load(spark, sf_dir).select("id", D.sleep(["observed", "exhausted"]).alias("sleeps"), D.retrieval_policy().alias("p"))
    return own.select("id", "sleeps", "p.*")


ASSERTED = Rows("orders", (f"{O} AS id", f"{O} % 9 > 0 AS schema_ok", "CAST(o_custkey % 12 AS DOUBLE) / 10 AS confidence", f"{O} % 4 > 0 AS spans_ok", "o_custkey % 3 AS citations", f"CAST({pick('o_custkey', '200', '404', '429', '503')} AS INT) AS http", f"CASE WHEN {O} % 4 > 0 THEN o_orderpriority END AS syndication", f"CASE WHEN {O} % 3 > 0 THEN o_custkey END AS native", "o_orderkey AS artifact"))


@query(ASSERTED.sql("""SELECT id, CASE WHEN NOT schema_ok THEN 'SCHEMA' WHEN confidence NOT BETWEEN 0 AND 1 THEN 'CONFIDENCE' WHEN NOT spans_ok THEN 'SPAN' WHEN citations < 1 THEN 'CITATION' END AS fault, CASE WHEN http = 404 THEN 'EXPIRED' WHEN http IN (429, 503) THEN 'RETRY' WHEN NOT spans_ok THEN 'IRRELEVANT' ELSE 'VALID' END AS invite,
CASE WHEN syndication IS NOT NULL THEN 'syndication:' || syndication WHEN native IS NOT NULL THEN 'native:' || native ELSE 'artifact:' || artifact END AS family FROM x"""))
def d25_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D25, D45, D21."""
    return ASSERTED.load(spark, sf_dir).select("id", D.assertion_error(c("schema_ok"), c("confidence"), c("spans_ok"), c("citations")).alias("fault"), D.invite_outcome(c("http"), c("spans_ok")).alias("invite"), D.family_identity("syndication", "native", "artifact").alias("family"))


GENERIC = "('" + "', '".join(text.GENERIC_WORDS) + "')"


@query(f"""SELECT doc_id, length(t) < 2 OR length(t) > 80 OR len(list_filter(string_split(t, ' '), lambda w: w NOT IN {GENERIC})) = 0 OR regexp_matches(t, '(?i){'|'.join(text.PROMOTION)}') OR regexp_matches(t, '^[0-9][0-9]?$') AS noise,
coalesce(regexp_matches(text, '(?i)(^|[^0-9A-Za-z_])(ignore (all |previous )?instructions|system prompt|developer message|jailbreak|respond with)([^0-9A-Za-z_]|$)'), FALSE) AS injected FROM (SELECT doc_id, text, lower(trim(regexp_replace(substring(coalesce(text, ''), 1, CAST(1 + doc_id % 90 AS INT)), '\\s+', ' ', 'g'))) AS t FROM documents)""")
def p13_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term is a document's first 1 to 90 characters."""
    term = F.expr("substring(coalesce(text, ''), 1, CAST(1 + doc_id % 90 AS INT))")
    return table(spark, sf_dir, "documents").withColumn("t", term).select("doc_id", text.boilerplate("t").alias("noise"), text.injected("text").alias("injected"))


INVITES = Rows("customer", ("c_custkey AS id", f"{pick('c_custkey', 'join https://discord.gg/', 'discord.com/invite/', 'www.discordapp.com/invite/', 'dsc.gg/', 'https://disboard.org/server/', 'no invite ')} || {pick('c_custkey * 7 + 3', 'Ab-', 'login', 'x', 'Code')} || CASE WHEN c_custkey % 4 = 1 THEN '' ELSE CAST(c_custkey AS STRING) END || ' and more' AS t"))


@query(INVITES.sql(r"""SELECT id, kind, CASE WHEN kind = 'NATIVE_INVITE' THEN 'discord:' || lower(code) ELSE lower(place) END AS locator, CASE WHEN kind = 'NATIVE_INVITE' THEN lower(code) END AS code FROM (SELECT id, regexp_extract(t, '((https?://)?(www\.)?[a-z]+\.(gg|com|org)/[^ ]+)', 1) AS place, regexp_extract(t, '([^/ ]+) and more$', 1) AS code, CASE WHEN t LIKE '%discord.gg/%' OR t LIKE '%/invite/%' THEN 'NATIVE_INVITE' WHEN t LIKE '%dsc.gg/%' THEN 'ALTERNATIVE_REDIRECT' WHEN t LIKE '%disboard.org/server/%' THEN 'DIRECTORY_PAGE' END AS kind FROM x) WHERE kind IS NOT NULL AND (kind <> 'NATIVE_INVITE' OR (length(code) >= 2 AND lower(code) <> 'login'))""").replace("AS STRING", "AS VARCHAR"))
def t21_invites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return INVITES.load(spark, sf_dir).select("id", F.explode(address.invites("t")).alias("i")).select("id", "i.*")


@query("SELECT event_id, CAST(ts AS DATE) AS day, (epoch_us(TIMESTAMP '2026-01-10') - epoch_us(ts)) / 86400000000.0 AS age FROM events")
def m02_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M02, M03."""
    now = F.lit("2026-01-10").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", days.utc_day("ts").alias("day"), numbers.age_days("ts", now).alias("age"))


AUDIENCE = Rows("customer", ("c_custkey AS id", f"{pick('c_custkey', '1.2K', '900', '12', 'HIDDEN', '3M', '29')} AS s"))


@query(AUDIENCE.sql("SELECT id, CASE WHEN s IN ('12', '29') THEN 'SKIP' ELSE 'PROCEED' END AS gate FROM x"))
def p05_low_audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AUDIENCE.load(spark, sf_dir).select("id", text.low_audience("s").alias("gate"))


SEARCHED = Rows("customer", ("c_custkey AS id", f"{pick('c_custkey', '(price action)', 'forex  +gold', 'plain words', '-minus word', 'a|b*c')} AS s"))


@query(SEARCHED.sql("SELECT id, CASE s WHEN '(price action)' THEN 'price action' WHEN 'forex  +gold' THEN 'forex gold' WHEN '-minus word' THEN 'minus word' WHEN 'a|b*c' THEN 'a b c' ELSE s END AS clean FROM x"))
def t14_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SEARCHED.load(spark, sf_dir).select("id", text.sanitize_query("s").alias("clean"))


FLAGS = ("has_context", "has_hint", "is_hub", "is_platform", "is_custom_domain", "is_affiliate", "is_broker")
PAGES = Rows("orders", (f"{O} AS id", f"{pick(O, 'CHANNEL_LINKS', 'ABOUT', 'PINNED', 'VIDEO', 'WEBSITE')} AS surface", *(f"({O} * {k + 2}) % {k + 3} = 0 AS {n}" for k, n in enumerate(FLAGS)), "o_custkey % 2 = 0 AS usable", "o_custkey % 3 AS ownership", f"{pick('o_custkey', 'VALID', 'PENDING', 'NULL')} AS status"))


@query(PAGES.sql("""SELECT id, CASE surface WHEN 'CHANNEL_LINKS' THEN 65 WHEN 'ABOUT' THEN 50 WHEN 'PINNED' THEN 45 WHEN 'VIDEO' THEN 10 ELSE 0 END + CASE WHEN has_context THEN 120 ELSE 0 END + CASE WHEN has_hint THEN 70 ELSE 0 END + CASE WHEN is_hub THEN 60 ELSE 0 END + CASE WHEN is_platform THEN 55 ELSE 0 END + CASE WHEN is_custom_domain THEN 20 ELSE 0 END - CASE WHEN is_affiliate THEN 75 ELSE 0 END - CASE WHEN is_broker THEN 45 ELSE 0 END AS score,
CASE WHEN usable THEN 10000 ELSE 0 END + 1000 * ownership + CASE status WHEN 'VALID' THEN 100 WHEN 'PENDING' THEN 50 ELSE 0 END AS rank FROM x"""))
def t24_surface_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T24, K10."""
    rank = D.community_rank(c("usable"), c("ownership"), c("status"), {"VALID": 100, "PENDING": 50})
    return PAGES.load(spark, sf_dir).select("id", address.surface_score("surface", *FLAGS).alias("score"), rank.alias("rank"))


HITS = Rows("customer", ("c_custkey AS id", f"{pick('c_custkey', 'www.spam.example', 'SPAM.example', 'good.example', 'notspam.example')} AS host", f"{pick('c_custkey + c_nationkey', 'Login page', 'A title', 'Sign up now')} AS title"))


@query(HITS.sql("SELECT id, CASE WHEN lower(host) IN ('www.spam.example', 'spam.example') THEN 'EXCLUDED_DOMAIN' WHEN title IN ('Login page', 'Sign up now') THEN 'NOISE_TITLE' END AS noise FROM x"))
def p14_noise_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HITS.load(spark, sf_dir).select("id", address.noise_reason("host", "title", ("spam.example",), "(?i)login|sign up").alias("noise"))

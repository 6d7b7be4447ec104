"""Decision tables and formulas that no driver table has columns for, row by row."""

from pyspark.sql import functions as F

from tidemill.functions import address, days, numbers, text
from tidemill.operators import allocation as L
from tidemill.operators import lifecycle as D
from tidemill.operators import reporting as P
from tidemill.sources import tables as S

c, lit = F.col, F.lit


def one(spark, x, **columns):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]) if columns else spark.range(1)
    return df.select(x.alias("x")).first().x


def test_formulas(spark):
    assert one(spark, numbers.propensity_weight(lit(2500))) == 4.0 and one(spark, numbers.propensity_weight(lit(0))) is None
    assert one(spark, numbers.exponential(lit(0.0))) == 1.0 and one(spark, numbers.frontier_score([lit(1.0), lit(2.0)], lit(0))) == 3.0
    assert one(spark, numbers.planner_utility(lit(1.0), lit(1.0), lit(1.0), lit(0.5), lit(100), lit(1))) == 7.0
    w = dict(incremental=1.0, information=1.0, coverage=1.0, uncertainty=1.0, freshness=1.0, provider_cost=0.5, review_cost=0.5, overlap=1.0, risk=1.0)
    x = one(spark, numbers.action_utility(w), depth=3, families=1, incremental=1.0, information=1.0, coverage=1.0, uncertainty=1.0, freshness=-2.0, provider_cost=2, review_cost=2, overlap=0.5)
    assert x == 4.0 - 1.0 - 1.0 - 0.5 - 1.0
    args = ["VIDEO", False, True, False, False, False, False, True]
    assert one(spark, address.surface_score(*[f"c{i}" for i in range(8)]), **{f"c{i}": a for i, a in enumerate(args)}) == 10 + 70 - 45


def test_text_and_days(spark):
    assert one(spark, text.code_point_slice("s", "a", "b"), s="a\U0001f600bc", a=1, b=3) == "\U0001f600b"
    assert one(spark, text.matches_any("s", ["cat", "dog"]), s="a dog") == ["dog"]
    assert one(spark, text.script_compatible("s", ["Latn"]), s="abc") and not one(spark, text.script_compatible("s", ["Latn"]), s="Привет")
    arr = lambda *v: F.array(*map(lit, v)) if v else F.array().cast("array<string>")
    assert one(spark, text.language_capability(lit("en"), lit(True), arr("Latn"), arr("Latn"))) == "SUPPORTED"
    assert one(spark, text.language_capability(lit("ru"), lit(True), arr("Latn"), arr("Cyrl"))) == "SCRIPT_MISMATCH"
    assert one(spark, text.language_capability(lit("xx"), lit(False), arr(), arr("Latn"))) == "PARTIAL"
    at = lit("2024-03-11 06:59:00").cast("timestamp")
    assert str(one(spark, days.utc_day(at))) == "2024-03-11" and str(one(spark, days.quota_day_start(at))) == "2024-03-10 08:00:00"
    assert len(one(spark, text.content_hash("s"), s="x")) == 64


def test_decisions(spark):
    pol = one(spark, D.retrieval_policy(), state="PRODUCTIVE", saturating=False, dup=0.8)
    assert (pol.eligible, pol.depth) == (True, 1)
    gate = dict(killed=False, pending=True, expired=False, state="OK", duplicate=False, spent=450.0, quota=60.0)
    assert one(spark, D.trial_gate(), **gate) == "DAILY_CAP" and one(spark, D.trial_gate(), **(gate | {"spent": 0.0})) == "ALLOWED"
    assert one(spark, D.trial_gate(), **(gate | {"killed": True})) == "KILL_SWITCH"
    r = one(spark, D.reactivation(), status="FAILED", validation="", manual=True, new_links=0, activity="DORMANT", age_days=31)
    assert r.reactivate and r.reasons == ["OPERATOR_NOMINATED_RECHECK", "COMMUNITY_FRESHNESS_INTERVAL_EXPIRED"]
    assert not one(spark, D.sleep(["a", "b"]), a=True, b=False, marginal_yield=0.01, upper_bound=0.1, threshold=0.2, probe_due=False)
    assert one(spark, D.sleep(["a", "b"]), a=True, b=True, marginal_yield=0.01, upper_bound=0.1, threshold=0.2, probe_due=False)
    assert one(spark, D.family_identity("a", "b"), a=None, b=7) == "b:7"
    rev = dict(country_rejected=False, terminal=False, operational_failure=False, investigating=True, degraded=True, documents=0)
    assert one(spark, D.review_eligibility(), **rev) == "INVESTIGATING" and one(spark, D.review_eligibility(), **(rev | {"investigating": False, "degraded": False, "documents": 1})) == "ELIGIBLE"
    fn = dict(retrieved=True, provider_failed=False, documents=2, semantic=True, families=1, score=0.2, threshold=0.5)
    assert one(spark, D.false_negative(), **fn) == "CORROBORATION" and one(spark, D.false_negative(), **(fn | {"families": 2})) == "SCORE"
    assert one(spark, P.lock_state("u", "2024-01-02"), u=None) == "FREE"


def test_proposals(spark):
    cells = spark.createDataFrame([("x", True, "ACTIVE", 45, None, 0.5, 0.4), ("y", False, "ACTIVE", 1, 0.1, 0.1, 0.1)], "cell string, reachable boolean, lifecycle string, days_since_probe int, estimated_unseen double, marginal_yield double, uncertainty double")
    assert [(r.cell, r.incremental, r.coverage, r.priority) for r in L.coverage_gap_actions(cells).collect()] == [("x", 0.2, 0.9, 3)]
    own = spark.createDataFrame([("k", "Alte Wörter", 2, "SUPPORTED"), ("k", "neu", 2, "SUPPORTED"), ("k", "one", 1, "SUPPORTED"), ("k", "no", 3, "ABSTAIN")], "concept string, surface string, families int, capability string")
    known = spark.createDataFrame([(" alte  WÖRTER ",)], "surface string")
    assert [r.surface for r in L.cross_language(own, known).collect()] == ["neu"]
    acts = L.propose_actions(spark.createDataFrame([(1, 0.5, None, 0.5, False)], "creator_id int, uncertainty double, unexplored double, confidence double, unresolved boolean")).collect()
    assert len(acts) == 4 and {r.action: r.information for r in acts}["INSPECT_COLLABORATOR"] == 0.3


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert [r.v for r in S.lookup(df, "k", 2).collect()] == ["b"]
    df.write.csv(f"{tmp_path}/c", header=True)
    assert S.imported(spark, f"{tmp_path}/c", "csv", header=True).count() == 2

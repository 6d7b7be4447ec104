import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import allocation as L
from tidemill.operators import analytics as A
from tidemill.operators import evaluation as E
from tidemill.operators import graph as G
from tidemill.operators import lifecycle as D
from tidemill.operators import relational as R
from tidemill.sources import tables as S

c = F.col


def test_funnel_counts_each_creator_once(spark):
    rows = [(1, 7, 1, "CONFIRMED", False, True, True, 80), (1, 7, 2, "NON_TRADING", False, True, False, 10), (1, 8, 3, "COUNTRY_REJECTED", True, False, False, 90)]
    schema = "run_id int, creator_id int, rank int, outcome string, was_known boolean, persisted boolean, has_community boolean, quality int"
    for order in (rows, rows[::-1]):
        f = A.query_funnel(spark.createDataFrame(order, schema), ["run_id"]).first()
        assert (f.raw_results, f.distinct_creators, f.duplicates, f.confirmed, f.evaluated, f.avg_quality) == (3, 2, 1, 1, 1, 80.0)
        assert (f.novelty, f.country_precision, f.trading_precision) == (0.5, 0.5, 1.0)
    assert A.query_funnel(spark.createDataFrame([], schema), ["run_id"]).count() == 0


def test_collections(spark):
    rows = [(10, 9, 1, 0.0, 0, 20.0, "EXPERIMENTAL", 1), (10, 0, 0, 0.5, 2, 61.0, "REJECTED", 1), (10, 0, 0, 0.5, 1, 24.0, "EXPERIMENTAL", 2), (10, 0, 0, 0.5, 1, 24.0, "EXPERIMENTAL", 1), (10, 0, 0, 0.5, 1, 40.0, "REJECTED", 5)]
    df = spark.createDataFrame(rows, "distinct_creators int, country_rejected int, non_trading int, trading_precision double, quality_creators int, score double, current string, runs int")
    assert [r[0] for r in df.select(A.query_collection(c("current"), c("runs"))).collect()] == ["REJECTED", "PROVEN", "REJECTED", "EXPERIMENTAL", "REJECTED"]


def test_apportion_conserves_its_total(spark):
    rng = random.Random(2)
    rows = [(g, f"b{k}", rng.randrange(0, 9), q) for g, q in ((1, 10), (2, 7), (3, 0), (4, 5)) for k in range(6)]
    rows = [(g, b, 0 if g == 4 else w, q) for g, b, w, q in rows]
    out = R.apportion(spark.createDataFrame(rows, "g int, band string, w int, q int"), ["g"], "w", "q", "band").groupBy("g").agg(F.sum("allocated").alias("s")).collect()
    assert {r.g: r.s for r in out} == {1: 10, 2: 7, 3: 0, 4: 0}


def test_asof_joins(spark):
    left = spark.createDataFrame([(1, "a", "2024-01-02"), (2, "a", "2024-01-05"), (3, "b", "2024-01-01"), (4, None, "2024-01-01")], "id int, k string, t string").withColumn("t", c("t").cast("timestamp"))
    right = spark.createDataFrame([("a", 10, "2024-01-02", 1), ("a", 11, "2024-01-02", 2), ("a", 12, "2024-01-04", 3), ("b", 13, "2024-01-02", 4)], "k string, v int, rt string, n int").withColumn("rt", c("rt").cast("timestamp"))
    back = {r.id: r.asof_v for r in R.asof_backward(left, right, "k", "t", "rt", "v", "n").collect()}
    assert back == {1: 11, 2: 12, 3: None, 4: None}
    ahead = {r.id: r.next_v for r in R.asof_forward(left, right, "k", "t", "rt", "2024-01-10", "v").collect()}
    assert ahead == {1: 10, 2: None, 3: 13, 4: None}
    assert R.asof_forward(left, right, "k", "t", "rt", "2024-01-02", "v").where("next_v IS NOT NULL").count() == 0


def test_forward_asof_reads_a_key_once(spark):
    rng = random.Random(3)
    left = [(n, rng.randrange(3), rng.randrange(40)) for n in range(80)]
    right = [(rng.randrange(3), rng.randrange(30), rng.randrange(40)) for _ in range(120)]
    at = c("t").cast("timestamp")
    df = R.asof_forward(spark.createDataFrame(left, "id int, k int, t long").withColumn("t", at), spark.createDataFrame(right, "k int, v int, t long").select("k", "v", at.alias("rt")), "k", "t", "rt", "1970-01-01 00:00:30", "v")
    want = {n: min(((x, v) for j, v, x in right if j == k and t <= x < 30), default=(0, None))[1] for n, k, t in left}
    assert {r.id: r.next_v for r in df.collect()} == want and None in want.values()
    assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()  # such a frame is read again for every row


def test_sets(spark):
    df = spark.createDataFrame([([1, 2], [2, 3]), ([], []), ([1], [])], "a array<int>, b array<int>")
    got = [tuple(r) for r in df.select(R.jaccard(c("a"), c("b")), R.containment(c("a"), c("b"))).collect()]
    assert got == [(1 / 3, 0.5), (0.0, 0.0), (0.0, 0.0)]


def test_serving_and_complement(spark):
    df = spark.createDataFrame([(True, True, False), (True, False, True), (False, False, True), (False, True, None)], "assigned boolean, projected boolean, legacy boolean")
    n = lambda m: df.where(R.serving_scope(m, c("assigned"), c("projected"), c("legacy"))).count()
    assert (n("OFF"), n("ACTIVE"), n("CANARY")) == (2, 2, 2)
    assert df.where(R.complement(c("legacy"))).count() == 2


def test_overlaps_and_slots(spark):
    rows = [(1, "k", 0, 5), (2, "k", 5, 8), (3, "k", 7, 9), (4, "k", 1, 2), (5, "j", 0, 9)]
    df = spark.createDataFrame(rows, "id int, k string, s int, e int")
    assert sorted(r.id for r in R.overlaps(df, "k", "s", "e", "id").collect()) == [3, 4]
    used = spark.createDataFrame([(1,), (2,), (4,), (4,), (None,)], "slot long")
    assert R.first_free_slot(used, 4).first().free_slot == 3
    assert R.first_free_slot(spark.range(1, 5).withColumnRenamed("id", "slot"), 4).first().free_slot is None


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", 5, ["x"]), (2, None, 7, ["y"])], "k int, name string, n int, tags array<string>")
    rows = spark.createDataFrame([(2, "b", 3, ["y", "z"]), (3, "c", 1, None)], "k int, name string, n int, tags array<string>")
    out = {r.k: (r.name, r.n, r.tags) for r in S.upsert(t, rows, ["k"], {"name": "coalesce", "n": "greatest", "tags": "union"}).collect()}
    assert out == {1: ("a", 5, ["x"]), 2: ("b", 7, ["y", "z"]), 3: ("c", 1, [])}
    new = S.insert_new(t, rows.unionByName(rows), ["k"], [F.asc("n")])
    assert [r.k for r in new.collect()] == [3]
    ev = spark.createDataFrame([(i, i) for i in range(9)], "event_id int, at int")
    S.append_audit(ev, f"{tmp_path}/audit")
    S.append_audit(ev.withColumn("event_id", c("event_id") + 100), f"{tmp_path}/audit")
    assert [r.event_id for r in S.audit(spark, f"{tmp_path}/audit", 3).collect()] == [108, 8, 107]
    assert S.audit(spark, f"{tmp_path}/audit", -5).count() == 1
    (tmp_path / "r.json").write_text('[{"a": 1}, {"a": "bad"}]')
    assert S.records(spark, f"{tmp_path}/r.json", "a int").count() == 2
    q = {r.check: r.violations for r in S.data_quality(spark.createDataFrame([(1, None), (1, 2)], "k int, v int"), ["k"], ["v"]).collect()}
    assert q == {"unique(k)": 1, "not_null(v)": 1}


@pytest.mark.parametrize("video,date", [(70, 60), (50, 10), (100, 100), (0, 60), (33, 33)])
def test_lanes_equal_the_recurrence(spark, video, date):
    df = spark.range(1, 200).withColumnRenamed("id", "i")
    got = [(r.n, r.lane, r.ordering) for r in L.lanes(df, [F.asc("i")], video, date).orderBy("n").collect()]
    assert got == L.lane_plan(199, video, date)


def brute_portfolio(rows, p):
    best = {}
    for r in rows:
        if r["action_id"] not in best or r["created_at"] > best[r["action_id"]]["created_at"]:
            best[r["action_id"]] = r
    score = lambda r: r["expected_reward"] / max(1, r["provider_cost"] + r["review_cost"])
    order = sorted(best.values(), key=lambda r: (-score(r), -r["priority"], r["created_at"], r["action_id"]))
    return [order[i]["action_id"] for i in sorted(L.take(order, p))]


def test_portfolio_against_all_candidates(spark):
    rng = random.Random(9)
    rows = [dict(action_id=i, program_id=rng.choice("AB"), action_type=rng.choice(["SEARCH_TERM", "X", "Y"]), priority=float(rng.randrange(3)), expected_reward=float(rng.randrange(40)), provider_cost=rng.randrange(1, 4), review_cost=rng.randrange(2), cluster_key=rng.randrange(4), created_at=f"2024-01-{rng.randrange(10, 28)}") for i in range(400)]
    p = L.Portfolio(30, 9, 5, {"B": 9, "A": 3}, {"X": 4}, search_floor=3)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "action_id long, program_id string, action_type string, priority double, expected_reward double, provider_cost long, review_cost long, cluster_key long, created_at string")
    got = L.best_first_portfolio(df, p).orderBy("rank").collect()
    assert [r.action_id for r in got] == brute_portfolio(rows, p)
    chosen = {r["action_id"]: r for r in rows}
    assert sum(chosen[r.action_id]["provider_cost"] for r in got) <= 30 and sum(chosen[r.action_id]["review_cost"] for r in got) <= 9
    none = L.best_first_portfolio(df, L.Portfolio(0, 0, 5)).collect()
    assert none == []
    again = L.contextual_portfolio(df, c("expected_reward") - c("provider_cost"), L.Portfolio(30, 9, 5, exploration_bp=3000)).collect()
    assert {r.reason for r in again} <= {"PROTECTED_EXPLORATION", "BEST_FIRST"} and any(r.reason == "PROTECTED_EXPLORATION" for r in again)


def test_round_robins(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 4, "x"), ("c", 5, "w")]
    df = spark.createDataFrame(rows, "g string, i int, d string")
    got = L.fair_round_robin(df, "g", [F.asc("i")], "d", 4, 1).orderBy("depth", "turn").collect()
    assert [(r.g, r.d) for r in got] == [("b", "x"), ("c", "w"), ("a", "y"), ("a", "z")]
    rows = [(f, k, i) for i, (f, k) in enumerate([("f1", "A")] * 4 + [("f2", "A")] * 3 + [("f1", "B")] * 3)]
    df = spark.createDataFrame(rows, "family string, country string, i int")
    got = L.bounded_round_robin(df, "family", "country", [F.asc("i")], 3, 3, 10).orderBy("place").collect()
    assert [(r.family, r.country) for r in got] == [("f1", "A"), ("f2", "A"), ("f1", "B"), ("f1", "A")]


def test_plan_queries(spark):
    atoms = [(f"t{i}", i % 3 + 1, f"i{i % 4}", i) for i in range(40)]
    got = L.plan_queries(spark.createDataFrame(atoms, "text string, tier int, intent string, priority int"), 10).collect()
    assert len(got) == 10 and sum(r.tier == 3 for r in got) <= 2 and len({r.intent for r in got}) == 4


def test_experiment_helpers(spark):
    df = spark.range(2000)
    arms = {r[0]: r[1] for r in df.groupBy(L.weighted_arm(c("id").cast("string"), [("a", 1), ("b", 3)])).count().collect()}
    assert 350 < arms["a"] < 650
    got = df.select(L.cohort("s", "p", 1, "id", 1000, 500, 2500).alias("x")).select("x.*").collect()
    assert {(r.cohort, r.inclusion_bp) for r in got} == {("PROTECTED", 3500), ("TARGETED", 3500), ("NOT_SELECTED", 6500)}
    assert spark.range(1).select(L.budget_share(L.daily_budget(F.lit(2.7), F.lit(1000.0)), F.lit(150)).alias("q")).first().q == 2000
    fixed = spark.createDataFrame([("cheap watch",), ("plain",)], "t string").select(L.reformulated(c("t"), [("cheap ", "")])).collect()
    assert [r[0] for r in fixed] == ["watch", None]


def test_isotonic_against_loop(spark):
    rng = random.Random(3)
    rows = [(i, round(rng.random(), 3), rng.random() < 0.5, rng.choice([2500, 5000, 10000])) for i in range(200)]
    df = spark.createDataFrame(rows, "key int, score double, truth boolean, inclusion_bp int")
    pts = sorted(((r.upper, r.probability, r.weight) for r in E.isotonic(df).collect()))
    assert [p[1] for p in pts] == sorted(p[1] for p in pts)
    assert sum(p[2] for p in pts) == pytest.approx(sum(10000 / r[3] for r in rows))
    assert sum(p[1] * p[2] for p in pts) == pytest.approx(sum(10000 / r[3] for r in rows if r[2]), rel=1e-6)
    got = {r.key: r.probability for r in E.apply_isotonic(df, E.isotonic(df)).collect()}
    for key, score, _, _ in rows:
        assert got[key] == next((p[1] for p in pts if score <= p[0]), pts[-1][1])


def test_rewards_and_stops(spark):
    df = spark.createDataFrame([(1, 2.0, False), (1, 4.0, False), (1, 9.0, True), (2, 5.0, False), (3, 1.0, True)], "k int, reward double, provisional boolean")
    got = {r.k: (r.n, r.final, r.mean, r.se) for r in E.rewards(df, ["k"]).collect()}
    assert got == {1: (3, 2, 3.0, 1.0), 2: (1, 1, 5.0, 0.0), 3: (1, 0, 0.0, 0.0)}


def test_cached_candidates(spark):
    rows = [("p", 40, 30, 20, 20.0, 10.0, ["c1", "c2"]), ("q", 40, 5, 1, 90.0, 900.0, ["c1"]), ("r", 3, 3, 3, 1.0, 1.0, [])]
    df = spark.createDataFrame(rows, "k string, results int, relevant int, verified int, quota_cost double, review_cost double, coverage_keys array<string>")
    got = {r.k: (r.decision, r.reasons, r.new_coverage) for r in E.cached_candidates(df, spark.createDataFrame([("c1",)], "cell string"), ["k"]).collect()}
    assert got["p"] == ("PASS", "", 1) and got["r"][0] == "INSUFFICIENT"
    assert got["q"] == ("FAIL", "PRECISION,QUALITY,COVERAGE,QUOTA,REVIEW", 0)


def test_states(spark):
    rows = [(0, 0.0, 0.0, 0.0, 0.0, 0.0, False, 0.0, 0.0), (2, 9.0, 1.0, 0.0, 0.0, 0.0, False, 0.0, 0.0), (5, 0.0, 0.0, 0.0, 0.0, 0.9, False, 0.0, 0.0), (5, 1.0, 0.01, 0.0, 0.5, 0.9, False, 1.0, 0.0), (5, 1.0, 0.01, 0.0, 0.5, 0.9, False, 0.0, 0.0), (5, 1.0, 0.04, 0.0, 0.5, 0.8, False, 0.0, 0.0), (5, 1.0, 0.2, 0.0, 0.5, 0.1, False, 1.0, 0.0), (5, 1.0, 0.1, 0.0, 0.5, 0.1, False, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "n int, mv double, rel double, qual double, known double, overlap double, saturating boolean, total_yield double, efficiency double")
    assert [r[0] for r in df.select(D.frontier_state()).collect()] == ["UNEXPLORED", "PROBING", "HARMFUL", "MAINTENANCE", "SATURATED", "SATURATING", "PRODUCTIVE", "PARTIALLY_OBSERVED"]
    terms = spark.createDataFrame([(5, 0.05, False, 9, 9, 9), (5, 0.5, True, 9, 9, 1), (3, 0.3, False, 1, 1, 1), (0, 0.0, False, 3, 2, 5), (0, 0.0, False, 3, 2, 2), (0, 0.0, False, 1, 1, 1), (0, 0.0, False, 0, 0, 0)], "executions int, term_yield double, is_brand boolean, creators int, communities int, evidence int")
    assert [r[0] for r in terms.select(D.term_lifecycle()).collect()] == ["DEMOTED", "OBSERVED", "PROVEN", "SEARCH_TRIAL", "MULTI_CREATOR_VALIDATED", "OBSERVED", "CANDIDATE"]


def test_transitions_and_replay(spark):
    df = spark.createDataFrame([("CANDIDATE", "ELIGIBLE"), ("CANDIDATE", "PROVEN"), ("PROVEN", "SATURATED")], "a string, b string")
    assert [r[0] for r in df.select(D.transition_valid(c("a"), c("b"), D.CATALOG)).collect()] == [True, False, True]
    ev = spark.createDataFrame([(1, 1, "OBSERVED", "REVIEW"), (1, 2, "REVIEW", "ADMITTED"), (1, 3, "REVIEW", "OBSERVED")], "k int, s int, prior string, result string")
    got = [r.mismatch for r in D.replay(ev, "k", "s", "prior", "result", D.ADMISSION, "OBSERVED").orderBy("s").collect()]
    assert got == ["", "", "PRIOR_MISMATCH,INVALID_TRANSITION"]
    p = D.projection(ev, "k", "s", "result")
    assert D.verify_projection(p, p, "k").count() == 0 and D.verify_projection(p, p.limit(0), "k").count() == 1


def test_concepts_follow_merges(spark):
    ev = [(1, "MERGED", "a", "b", None), (2, "MERGED", "b", "c", None), (3, "MERGED", "x", "y", None), (4, "CORRECTION", "c", "d", None), (5, "SPLIT", None, "a", "d"), (6, "MERGED", "a", "z", None), (7, "MERGED", "z", None, None)]
    events = spark.createDataFrame(ev, "seq int, kind string, source string, target string, split_from string")
    want = {}
    for concept in "abcdxz":
        now = concept
        for _, kind, source, target, split in ev:
            if target and (split == now and target == concept if kind == "SPLIT" else source == now):
                now = target
        want[concept] = now
    got = D.project_concept(spark.createDataFrame([(x,) for x in "abcdxz"], "concept string"), events)
    assert {r.concept: r.canonical for r in got.collect()} == want and want["a"] == "z"


def test_long_histories_of_concepts_take_few_jobs(spark):
    rng = random.Random(5)
    ev = [(k // 2, rng.choice(["MERGED", "SPLIT", "CORRECTION", None]), rng.randrange(5), rng.choice([0, 1, 2, 3, 4, None]), rng.randrange(5)) for k in range(160)]
    want = []
    for concept in (0, 1, 2, 3, 4, 4, 9, None):
        now = concept
        for seq in range(80):  # of events with one seq the least target
            now = min((t for s, kind, source, t, split in ev if s == seq and t is not None and (split == now and t == concept if kind == "SPLIT" else source == now)), default=now)
        want.append((concept, now))
    spark.sparkContext.setJobGroup("concepts", "")
    names = spark.createDataFrame([(x,) for x, _ in want], "concept int")
    got = D.project_concept(names, spark.createDataFrame(ev, "seq long, kind string, source int, target int, split_from int")).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("concepts"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert 0 < jobs < 8


def test_retry_backoff(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    df = spark.createDataFrame([(True, 1, 0.0, None), (True, 3, 0.0, None), (True, 9, 0.0, None), (True, 1, 7.0, None), (False, 1, 0.0, None)], "transient boolean, n int, age double, at timestamp")
    got = [(r.r.action, str(r.r.run_after)) for r in df.select(D.retry_directive(c("transient"), c("n"), c("age"), now, c("at")).alias("r")).collect()]
    assert got == [("RETRY", "2024-01-01 00:00:30"), ("RETRY", "2024-01-01 00:02:00"), ("RETRY", "2024-01-01 00:15:00"), ("FAILED", "None"), ("FAILED", "None")]


def test_country_ties(spark):
    ev = [(1, "A", 1, 100), (1, "B", 2, 92), (2, "A", 5, 78), (2, "B", 5, 78), (3, "X", 1, 100), (4, "A", 9, 58)]
    got = {r.k: (r.country, r.status, r.confidence, r.conflict) for r in D.country(spark.createDataFrame(ev, "k int, country string, priority int, confidence int"), "k", ["X"]).collect()}
    assert got == {1: ("A", "CONFIRMED", 100, False), 2: ("A", "UNCERTAIN", 49, True), 3: ("X", "REJECTED", 100, False), 4: ("A", "UNCERTAIN", 58, False)}


def test_rule_tables(spark):
    one = spark.range(1)
    get = lambda x: one.select(x.alias("x")).first().x
    t, f, lit = F.lit(True), F.lit(False), F.lit
    assert get(D.assertion_error(t, lit(1.5), t, lit(1))) == "CONFIDENCE" and get(D.assertion_error(t, lit(0.5), t, lit(1))) is None
    assert get(D.rate_pressure(lit("DEFER"), t, lit(10), lit(3), t, t, lit(0.01))) == "WITHHOLD"
    assert get(D.invite_outcome(lit(200), f)) == "IRRELEVANT" and get(D.vitality(lit(70), lit(91))).band == "MEDIUM"
    assert get(D.community_rank(t, lit(2), lit("VALID"), {"VALID": 100})) == 12_100
    assert get(D.burst(lit(3), lit(1))) and not get(D.burst(lit(2), lit(0)))
    assert get(D.staged_backoff(lit(0))) == 30.0 and get(D.staged_backoff(lit(20))) == 3600.0


def test_graph(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2), (9, 9)], "parent long, child long")
    assert {r.node for r in G.cyclic(links).collect()} == {2, 3, 4, 9}
    got = {(r.ancestor, r.descendant): r.depth for r in G.closure(links.where("parent < 4 OR parent = 0"), 5).collect()}
    assert got == {(1, 2): 1, (2, 3): 1, (3, 4): 1, (1, 3): 2, (2, 4): 2, (1, 4): 3}
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "y"), (1, "x")], "k int, v string")
    assert G.sealed(a, []).collect() == G.sealed(b, []).collect()


def test_closure_of_any_depth(spark):
    chain = [(i, i + 1) for i in range(12)]
    ring = [(100 + i, 100 + (i + 1) % 11) for i in range(11)]
    links = spark.createDataFrame([*chain, *ring, (None, 0), (5, None), (None, 100), (0, 1)], "parent long, child long")
    got = [tuple(r) for r in G.closure(links).where("ancestor < 100 AND descendant IS NOT NULL").collect()]
    assert sorted(got) == [(a, b, b - a) for a in range(13) for b in range(a + 1, 13)]
    every = G.closure(links).collect()
    assert len(every) == len({(r.ancestor, r.descendant) for r in every}) and max(r.depth for r in every) == 13
    assert {r.node for r in G.cyclic(links).collect()} == set(range(100, 111))
    assert max(r.depth for r in G.closure(links, 3).collect()) == 3 and G.cyclic(links, 10).count() == 0
    assert G.closure(links.where("false")).count() == 0


def test_continuation_streaks(spark):
    low, high = (0.0,) * 7, (1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0)
    rows = [(1, p, *(low if p in (2, 3, 5) else high), 1, 1) for p in range(1, 7)]
    df = spark.createDataFrame(rows, "key int, page int, qy double, cy double, nov double, cp double, div double, dup double, nt double, confirmed int, new int")
    assert [r.streak for r in D.continuation(df).orderBy("page").collect()] == [0, 1, 2, 0, 1, 0]


def test_packed_runs_count_as_rows_do(spark, monkeypatch):
    from tidemill.operators import corpus as C

    rng = random.Random(11)
    texts = [" ".join(rng.choice(["a", "b", "cé", "d.e", "12", "from", "g", "ΑΣ", "h", "\U00010400x"]) + rng.choice(["", "", "", "!", "\n"]) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + ["", None, "only", "x y z w v u t s r"]
    rows = [(k, t, rng.choice(["p", "q", "r", None]), rng.randrange(3), rng.choice([0, 1, None]), rng.choice(["en", "de", None])) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc long, text string, creator string, community int, family int, language string").repartition(3)
    monkeypatch.setattr(C, "CHUNK", 90)
    for got, want in (
        (C.mine_texts(docs), C.mine(C.tokens(docs, most=2, pattern=C.SURFACE))),
        (C.hypotheses_of_texts(docs), C.hypotheses(C.tokens(docs, most=4))),
        (C.hypotheses_of_texts(docs, 5, 0, 1), C.hypotheses(C.tokens(docs, most=5), 0, 1)),
    ):
        rows = sorted(map(tuple, want.select(got.columns).collect()), key=str)
        assert rows and sorted(map(tuple, got.collect()), key=str) == rows and got.dtypes == want.select(got.columns).dtypes
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan  # no run is a row before it is moved

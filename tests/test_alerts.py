import pytest
from pyspark.sql import functions as F

from conftest import day, scored
from fieldpulse.operators import orders as O
from fieldpulse.operators import risk as K
from fieldpulse.operators import rules as A


def alerts(df):
    return sorted((r["object_id"], r["date"]) for r in df.where("alert").collect())


def test_run_length_rules(spark):
    rows = [("A", d, s) for d, s in enumerate([.9, .1, .9, .9, .9, .9, .1, .9, .9])] + [("B", d, .9) for d in range(2)]
    assert alerts(A.persist_mask(scored(spark, rows), 0.5, 3)) == [("A", day(4)), ("A", day(5))]


def test_runs_count_observations_not_days(spark):
    df = scored(spark, [("A", 0, .9), ("A", 10, .9), ("A", 40, .9)])
    assert alerts(A.persist_mask(df, 0.5, 3)) == [("A", day(40))]


def test_smoothing_is_per_object(spark):
    df = scored(spark, [("A", 0, 0), ("A", 1, 1), ("A", 2, 0), ("B", 0, 1), ("B", 1, 1)])
    out = {(r["object_id"], r["date"]): r["ewma5"] for r in A.ewma_score(df, 5).collect()}
    assert out["A", day(1)] == pytest.approx(1 / 3) and out["A", day(2)] == pytest.approx(2 / 9)
    assert out["B", day(0)] == 1.0 and out["B", day(1)] == pytest.approx(1.0)
    assert alerts(A.mask(df, A.Profile("ewma5", "ewma", span=5), 0.5)) == [("B", day(0)), ("B", day(1))]


def test_cooldown_opens_inspections(spark):
    fired = scored(spark, [("A", 0, 1), ("A", 1, 1), ("A", 15, 1), ("A", 30, 1), ("B", 0, 1)])
    assert A.inspections(fired, 14).first()["inspections"] == 3
    assert A.inspections(fired.limit(0), 14).first()["inspections"] == 0
    orders = {(r["object_id"], r["opened_at"]): r for r in O.to_orders(fired, 14).collect()}
    assert set(orders) == {("A", day(0)), ("A", day(30)), ("B", day(0))}
    assert (orders["A", day(0)]["last_alert_at"], orders["A", day(0)]["alert_days"]) == (day(15), 3)


def test_queue_gate_and_day(spark):
    df = scored(spark, [("A", 0, .9), ("B", 5, .8), ("C", 40, .95), ("D", 1, .1)])
    assert [r["object_id"] for r in O.head(O.order_queue(df, A.Profile("b"), 0.5), 2).collect()] == ["C", "A"]
    members = spark.createDataFrame([("B",)], "object_id string")
    assert [r["object_id"] for r in O.order_queue(df, A.Profile("b"), 0.5, members=members).collect()] == ["B"]
    # an order shows from its opening until the cooldown after its last alert
    on = lambda d: sorted(r["object_id"] for r in O.order_queue(df, A.Profile("b"), 0.5, str(day(d))).collect())
    assert on(14) == ["A", "B"] and on(15) == ["B"] and on(20) == [] and on(40) == ["C"]


@pytest.fixture(scope="module")
def panel(spark):
    """Forty objects over sixty days; every fourth fails after the period and scores high before."""
    rows = []
    for o in range(40):
        for d in range(0, 60, 1 + o % 2):
            fails = o % 4 == 0
            score = ((o * 37 + d * 17) % 100) / 200 + (0.5 if fails and d > 40 and (d + o) % 3 else 0)
            rows.append((f"o{o:02d}", d, score, (65 - d) * 24.0 if fails else None))
    return scored(spark, rows).cache()


def expected_rule(rows, fired, cooldown=14):
    """Plain Python over the whole little panel."""
    window = {o for o, d, s, t in rows if t is not None and 0 < t <= 1440}
    leads, orders, last = {}, 0, {}
    for o, d, s, t in sorted(fired):
        orders += o not in last or (d - last[o]).days > cooldown
        last[o] = d
        if t is not None and 0 < t <= 1440:
            leads[o] = max(leads.get(o, 0), t / 24)
    return len(fired), orders, len(window), len(leads)


def test_eval_rule(spark, panel):
    rows = [tuple(r) for r in panel.collect()]
    for thr in (0.3, 0.6, 2.0):
        got = A.eval_rule(panel, panel.where(F.col("score") >= thr)).first()
        want = expected_rule(rows, [r for r in rows if r[2] >= thr])
        assert (got["alert_days"], got["inspections"], got["fail_objects"], got["detected"]) == want
        assert got["kappa_star"] == (pytest.approx(want[1] / want[3]) if want[3] else None)


def test_sweep_agrees_with_single_rules(spark, panel):
    members = spark.createDataFrame([(f"o{i:02d}",) for i in range(0, 40, 4)], "object_id string")
    profiles = A.default_profiles(["top30"])
    frontier = A.sweep(A.sweep_input(panel, profiles, {"top30": members}), profiles, (0.9, 0.999, 5)).cache()
    assert frontier.count() == len(profiles) * 5
    for p in profiles:
        for r in frontier.where((F.col("profile") == p.name) & F.col("step").isin(0, 3)).collect():
            fired = A.mask(panel, p, r["threshold"] - 1e-12).where("alert")
            fired = A.gate(fired, members) if p.kind == "gate" else fired
            one = A.eval_rule(panel, fired).first()
            for c in ("alert_days", "inspections", "fail_objects", "detected"):
                assert r[c] == one[c], (p.name, r["step"], c)
    best = {r["profile"]: r for r in A.pick_profiles(frontier, 0.3).collect()}
    usable = {k: r["kappa_star"] for k, r in best.items() if r["kappa_star"] is not None}
    assert sum(r["is_default"] for r in best.values()) == 1
    assert [k for k, r in best.items() if r["is_default"]][0] in [k for k, v in usable.items() if v == min(usable.values())]
    kappa = {r["profile"]: r["kappa_star"] for r in A.kappa_at_detection(frontier, 0.3).collect()}
    assert {k: round(v, 2) for k, v in kappa.items() if v} == pytest.approx(usable)


def test_nothing_qualifies_means_baseline(spark, panel):
    profiles = [A.Profile("baseline"), A.Profile("persist3", "persist", n=3)]
    rows = A.pick_profiles(A.sweep(A.sweep_input(panel, profiles), profiles), 1.1).collect()
    assert [r["profile"] for r in rows if r["is_default"]] == ["baseline"]


def test_ranks_lists_and_cards(spark):
    df = scored(spark, [("A", 0, .9), ("B", 0, .9), ("C", 0, .1), ("A", 1, .2), ("C", 1, .3)])
    ranked = K.rank_in_day(df)
    assert {(r["object_id"], r["date"]): r["rank"] for r in ranked.collect()} == {
        ("A", day(0)): 1, ("B", day(0)): 1, ("C", day(0)): 3, ("A", day(1)): 2, ("C", day(1)): 1}
    assert [r["object_id"] for r in K.ranking(ranked).collect()] == ["C", "A"]
    assert [r["object_id"] for r in K.ranking(ranked, str(day(0)), 2).collect()] == ["A", "B"]
    chronic = K.chronic_rank(spark.createDataFrame([("A", 3.0), ("B", 5.0), ("C", 3.0)], "object_id string, chronic_score double"))
    assert {r["object_id"]: r["chronic_rank"] for r in chronic.collect()} == {"A": 2, "B": 1, "C": 2}
    assert [r["object_id"] for r in K.watchlist(chronic, 2).collect()] == ["B", "A"]
    assert K.chronic_top(chronic, 0.7).count() == 2 and K.chronic_top(chronic, 0.01).count() == 1
    assert K.chronic_top_by_score(chronic, 0.6).count() == 3  # ties at the cut all belong
    meta = spark.createDataFrame([("A", "t", "f", "n", "m", "r")], "object_id string, object_type string, facility_type string, facility_name string, municipality string, rso string")
    cards = {r["object_id"]: r for r in K.object_cards(ranked, K.object_thresholds(df), chronic, meta, str(day(1)), 0.5).collect()}
    assert cards["B"]["date"] == day(0) and cards["A"]["date"] == day(1) and cards["A"]["municipality"] == "m"
    assert cards["A"]["p75"] == pytest.approx(0.725) and cards["B"]["municipality"] is None
    assert [r["score"] for r in K.risk_timeline(df, "A", str(day(1))).collect()] == [0.2]
    assert K.global_thresholds(df, 0.5).first()["p50"] == pytest.approx(0.3)
    above = {(r["object_id"], r["date"]): r["above_p75"] for r in K.above_own_p75(df, K.object_thresholds(df)).collect()}
    assert above["A", day(0)] == 0.9 and above["A", day(1)] is None


def test_baseline_uses_the_first_days(spark):
    df = scored(spark, [("A", d, d) for d in range(40)] + [("B", d, d) for d in range(35, 40)])
    got = {r["object_id"]: r["score"] for r in K.object_baseline(df, ["score"], 30).collect()}
    assert got == {"A": 14.5, "B": 37.0}

"""Visit evidence: outcomes of planned claims, a second run, faults of claims."""

from cantera.operators import visits

CHECK = "ref string, nth int, category string, quote string, text string, fact string, kind string, value string"


def tables(spark):
    checks = [
        ("v1", 0, "price", "cuesta 0,85", "Nota: cuesta 0,85 hoy", "price", "number", "0.85"), ("v1", 1, "price", "cuesta 10,85", "cuesta 10,85", "price", "number", "0.85"),
        ("v1", 2, "access", "hay rampa", "hay  rampa", "ramp", "boolean", "true"), ("v1", 3, "access", "hay rampa", "hay rampa", "price", "boolean", "true"),
        ("v1", 4, "services", "de 9:00 a 14:30", "de 9:00 a 14:30", "hours", "string", "09:00-14:30"), ("v1", 5, "services", "de 9:00", "de 9:00", "hours", "string", "09:00-14:30"),
        ("v1", 6, "parking", "El  Faro", "dice: El Faro", "name", "string", "el faro"), ("v1", 7, "parking", "El Faro", "El Faro", "name", "string", "EL FARO"),
        ("v2", 0, "parking", "El Faro", "El Faro", "name", "string", "el faro"), ("v2", 1, "parking", "x", "otra cosa", "name", "string", "x"), ("v2", 2, "parking", "x", "x", "nothing", "string", "x"),
        ("v2", 3, "parking", "x", "x", None, "string", "x"), ("v2", 4, "parking", " ", "x", None, None, None), ("v2", 5, "parking", "x", "x", None, None, None), ("v2", 6, "parking", "x", "x", "name", "string", None), ("v2", 7, "nada", "x", "x", None, None, None),
    ]
    facts = [("price", "€"), ("ramp", visits.BOOLEAN), ("hours", visits.HOURS), ("name", "texto"), ("name", "texto")]
    claims = [("name", "v2", "string", "El  Faro"), ("name", "w", "string", "Otro"), ("price", "w", "number", "1")]
    return spark.createDataFrame(checks, CHECK), spark.createDataFrame(facts, "fact string, unit string"), spark.createDataFrame(claims, "fact string, ref string, kind string, value string")


def test_outcomes(spark):
    checks, facts, claims = tables(spark)
    got = {(r.ref, r.nth): (r.outcome, r.others) for r in visits.plan_claims(checks, facts, claims).collect()}
    assert got == {
        ("v1", 0): ("append", 1), ("v1", 1): ("reject", 1), ("v1", 2): ("needs confirmation", 0), ("v1", 3): ("reject", 1), ("v1", 4): ("append", 0), ("v1", 5): ("reject", 0),
        ("v1", 6): ("append", 1), ("v1", 7): ("repeated", 1), ("v2", 0): ("already there", 1), ("v2", 1): ("reject", 2), ("v2", 2): ("reject", 0), ("v2", 6): ("reject", 2),
    }
    faults = {(r.ref, r.nth): r.fault for r in visits.visit_issues(checks, facts).collect()}
    assert faults == {
        ("v1", 1): "not-literal", ("v1", 3): "not-literal", ("v1", 5): "not-literal", ("v2", 1): "quote-not-in-text", ("v2", 2): "unknown-fact", ("v2", 3): "value-without-fact", ("v2", 4): "quote-missing", ("v2", 6): "value-missing", ("v2", 7): "category",
    }


def test_a_second_run_plans_nothing(spark):
    checks, facts, claims = tables(spark)
    first = visits.planned(visits.plan_claims(checks, facts, claims), confirmed=True)
    assert first.count() == 4
    now = claims.unionByName(first)
    again = visits.plan_claims(checks, facts, now)
    assert visits.planned(again, confirmed=True).count() == 0
    assert {r.outcome for r in again.collect()} == {"already there", "reject"}


def test_claims_need_their_visit(spark):
    checks, facts, _ = tables(spark)
    claims = spark.createDataFrame([("name", "v1", "string", "El Faro"), ("name", "v9", "string", "x"), ("ramp", "v2", "boolean", "true"), ("price", "v1", "number", "2"), ("ramp", "v1", "boolean", "true"), ("hours", "v1", "string", "09:00-14:30"), ("nothing", "v2", "string", "x"), ("name", None, "string", "x")], "fact string, ref string, kind string, value string")
    assert {(r.fact, r.ref): r.fault for r in visits.claim_faults(claims, checks, facts).collect()} == {("name", "v9"): "no-visit", ("ramp", "v2"): "no-check", ("price", "v1"): "other-value", ("name", None): "no-visit"}
    assert visits.claim_faults(claims.limit(0), checks, facts).collect() == []


def test_checks_are_verified_once(spark):
    rows = [("v", 0, "price", "Son 5", "Son 5", "f", "number", "5"), ("v", 1, "price", "Son 5", "Son 5", "f", "number", "5"), (None, 2, "price", "Son 5", "Son 5", "f", "number", "5"), (None, 3, "price", "Son 5", "Son 5", "f", "number", "5")]
    checks = spark.createDataFrame(rows, "ref string, nth int, category string, quote string, text string, fact string, kind string, value string")
    facts, claims = spark.createDataFrame([("f", "uds")], "fact string, unit string"), spark.createDataFrame([], "fact string, ref string, kind string, value string")
    plan = visits.plan_claims(checks, facts, claims)
    assert {(r.nth, r.outcome) for r in plan.collect()} == {(0, "append"), (1, "repeated"), (2, "append"), (3, "append")}
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("quote-not-in-text") == 1

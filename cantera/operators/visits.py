"""Evidence of visits: what a person noted on the spot, checked against facts and their claims.

A check is (ref, nth, category, quote, text, fact, kind, value): the visit, its place in it,
the words noted and the whole note, and the value read from them, if it is about a fact.
Facts are (fact, unit); claims (fact, ref, kind, value). Values are texts with a kind:
string, number or boolean. The three sides meet by (fact) and by (ref, fact, value key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantera.functions.extract import quoted_hours, quoted_number
from cantera.operators.facts import value_key

# Units with rules of their own, and the categories of checks.
BOOLEAN, HOURS = "booleano", "hh:mm"
CATEGORIES = ("price", "access", "parking", "accessibility", "services")


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def literal(kind: Column, value: Column, unit: Column, quote: Column) -> Column:
    """Whether a value stands in a quote as it is: numbers with a comma or a point, hours with or without their first zero, texts whatever their case; a boolean never does, and is taken if the fact is one."""
    said = F.contains(F.lower(plain(quote)), F.lower(plain(value)))
    out = F.when(kind == "boolean", unit == BOOLEAN).when(kind == "number", quoted_number(value.try_cast("double"), quote)).when(unit == HOURS, quoted_hours(value, quote)).otherwise(said)
    return F.coalesce(out, F.lit(False))


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _verified(checks: DataFrame, facts: DataFrame) -> DataFrame:
    """Checks with the unit of their fact and the first thing that is wrong with them."""
    known = facts.select(F.col("fact").alias("_fact"), "unit").dropDuplicates(["_fact"])
    rows = checks.join(known, checks["fact"] == F.col("_fact"), "left")
    fault = (
        F.when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "category")
        .when(~_filled(F.col("quote")), "quote-missing")
        .when(~F.coalesce(F.contains(plain(F.col("text")), plain(F.col("quote"))), F.lit(False)), "quote-not-in-text")
        .when(F.col("fact").isNull() & F.col("value").isNotNull(), "value-without-fact")
        .when(F.col("fact").isNotNull() & ~_filled(F.col("value")), "value-missing")
        .when(F.col("fact").isNotNull() & F.col("_fact").isNull(), "unknown-fact")
        .when(F.col("fact").isNotNull() & ~literal(F.col("kind"), F.col("value"), F.col("unit"), F.col("quote")), "not-literal")
    )
    return rows.withColumn("fault", fault).drop("_fact")


def visit_issues(checks: DataFrame, facts: DataFrame) -> DataFrame:
    """(ref, nth, fault) of checks that can't count."""
    return _verified(checks, facts).where("fault IS NOT NULL").select("ref", "nth", "fault")


def plan_claims(checks: DataFrame, facts: DataFrame, claims: DataFrame) -> DataFrame:
    """(ref, nth, fact, kind, value, outcome, others) for every check about a fact.

    The outcome is ``reject``, ``already there`` (a claim of this visit has the value),
    ``needs confirmation`` (a boolean is a reading, not a quote), ``append``, or ``repeated``
    for a check that an earlier one of its visit makes again. ``others`` counts the
    differing values that the fact's claims have: appending makes a conflict of them.
    """
    rows = _verified(checks, facts).where("fact IS NOT NULL").withColumn("_key", value_key(F.col("kind"), F.col("value")))
    key = value_key(F.col("kind"), F.col("value"))
    there = claims.select(F.col("ref").alias("_ref"), F.col("fact").alias("_of"), key.alias("_there")).distinct()
    values = claims.select(F.col("fact").alias("_of2"), key.alias("_v")).distinct().groupBy("_of2").agg(F.count("*").alias("_n"))
    same = claims.select(F.col("fact").alias("_of3"), key.alias("_v3")).distinct()
    # What is keyed by the fact alone comes right after its unit, what is keyed by the whole check comes last, so that neither moves rows again.
    rows = rows.join(values, F.col("fact") == F.col("_of2"), "left").join(same, (F.col("fact") == F.col("_of3")) & (F.col("_key") == F.col("_v3")), "left")
    rows = rows.join(there, (F.col("ref") == F.col("_ref")) & (F.col("fact") == F.col("_of")) & (F.col("_key") == F.col("_there")), "left")
    first = F.min(F.when(F.col("fault").isNull(), F.col("nth"))).over(Window.partitionBy("ref", "fact", "_key"))
    rows = rows.withColumn("_first", F.when(F.col("ref").isNotNull(), first))
    outcome = F.when(F.col("fault").isNotNull(), "reject").when(F.col("_there").isNotNull(), "already there").when(F.col("nth") > F.col("_first"), "repeated").when(F.col("kind") == "boolean", "needs confirmation").otherwise("append")
    others = F.coalesce("_n", F.lit(0)) - F.col("_v3").isNotNull().cast("int")
    return rows.select("ref", "nth", "fact", "kind", "value", outcome.alias("outcome"), others.cast("long").alias("others"))


def planned(plan: DataFrame, confirmed: bool = False) -> DataFrame:
    """(fact, ref, kind, value): the claims to append; booleans too once a person has confirmed them."""
    wanted = ["append", "needs confirmation"] if confirmed else ["append"]
    return plan.where(F.col("outcome").isin(wanted)).select("fact", "ref", "kind", "value")


def claim_faults(claims: DataFrame, checks: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact, ref, value, fault): claims that cite a visit which doesn't back them.

    A claim needs its visit, a check of its fact there, with its value, written in the
    quote. The checks of a visit are summed up by (ref, fact, value key) before they meet
    the claims.
    """
    key = value_key(F.col("kind"), F.col("value"))
    visits = checks.select(F.col("ref").alias("_ref")).distinct()
    units = facts.select(F.col("fact").alias("_fact"), "unit").dropDuplicates(["_fact"])
    noted = checks.where("fact IS NOT NULL").join(units, checks["fact"] == F.col("_fact"), "left")
    read = noted.withColumn("_lit", literal(F.col("kind"), F.col("value"), F.col("unit"), F.col("quote")))
    per_fact = read.groupBy(F.col("ref").alias("_r"), F.col("fact").alias("_f")).agg(F.count("*").alias("_n"))
    backing = read.groupBy(F.col("ref").alias("_r2"), F.col("fact").alias("_f2"), key.alias("_k")).agg(F.min_by("_lit", "nth").alias("_lit"))
    rows = claims.withColumn("_key", key).join(visits, F.col("ref") == F.col("_ref"), "left").join(per_fact, (F.col("ref") == F.col("_r")) & (F.col("fact") == F.col("_f")), "left")
    rows = rows.join(backing, (F.col("ref") == F.col("_r2")) & (F.col("fact") == F.col("_f2")) & (F.col("_key") == F.col("_k")), "left")
    fault = F.when(F.col("_ref").isNull(), "no-visit").when(F.col("_n").isNull(), "no-check").when(F.col("_k").isNull(), "other-value").when(~F.col("_lit"), "not-literal")
    return rows.select("fact", "ref", "value", fault.alias("fault")).where("fault IS NOT NULL")

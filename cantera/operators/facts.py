"""Practical facts: sources, resolution with a human override, snapshots, conflicts, operational status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes of sources, best first, and those that confirm a fact.
CLASSES = ("official-location", "official-brand", "manual-first-party", "open-data", "third-party")
CONFIRMING = CLASSES[:3]
FRESH_DAYS = 180


def class_of(given: Column) -> Column:
    """A source without a class is trusted least."""
    return F.coalesce(given, F.lit(CLASSES[-1]))


def class_rank(given: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CLASSES]), class_of(given))


def value_key(kind: Column, value: Column) -> Column:
    """Type and text of a value, for comparison; strings without case or surplus space."""
    text = F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))
    return F.concat_ws(":", kind, F.when(kind == "string", text).otherwise(value))


def resolve(facts: DataFrame, claims: DataFrame) -> DataFrame:
    """(fact, status, value, source_class, retrieved): what the claims on each fact come to.

    ``facts`` has fact, municipal (whether only an official place confirms), chosen (the ord
    of the claim that a person settled on), chosen_value and reviewed; ``claims`` has fact,
    ord, kind, value, source_class and retrieved (text that starts with a date). No claim is
    unknown; differing values are a conflict, unless the review isn't older than the latest
    claim; else the best claim counts: by class, then the latest, then the first. One
    aggregation, without a sort of the claims.
    """
    row = F.struct("value", "source_class", "retrieved")
    rows = claims.join(facts.select("fact", "chosen"), "fact", "left")
    best = F.struct((-class_rank(F.col("source_class"))).alias("a"), F.col("retrieved").alias("b"), (-F.col("ord")).alias("c"))
    found = rows.groupBy("fact").agg(
        F.min(value_key(F.col("kind"), F.col("value"))).alias("_lo"),
        F.max(value_key(F.col("kind"), F.col("value"))).alias("_hi"),
        F.max(F.substring("retrieved", 1, 10)).alias("_latest"),
        F.max_by(row, best).alias("_best"),
        F.max(F.when(F.col("ord") == F.col("chosen"), row)).alias("_picked"),
    )
    all_ = facts.join(found, "fact", "left")
    settled = F.when(F.col("reviewed").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.col("reviewed") >= F.col("_latest")), F.col("_picked"))
    differ = F.col("_lo") != F.col("_hi")
    claim = F.when(differ, settled).otherwise(F.col("_best"))
    confirms = F.when(F.coalesce("municipal", F.lit(False)), class_of(claim["source_class"]) == CLASSES[0]).otherwise(class_of(claim["source_class"]).isin(*CONFIRMING))
    status = F.when(F.col("_lo").isNull(), "unknown").when(claim.isNull(), "conflict").when(confirms, "confirmed").otherwise("needs verification")
    value = F.when(differ, F.coalesce("chosen_value", claim["value"])).otherwise(claim["value"])
    return all_.select("fact", status.alias("status"), value.alias("value"), F.when(claim.isNotNull(), class_of(claim["source_class"])).alias("source_class"), claim["retrieved"].alias("retrieved"))


def citation_issues(citations: DataFrame, facts: DataFrame, fields: list[str]) -> DataFrame:
    """(page, fact, code): citations of facts that don't exist, and fields of the snapshot that differ from the fact."""
    known = facts.select(F.col("fact").alias("_fact"), *[F.col(c).alias(f"_{c}") for c in fields])
    both = citations.join(known, F.col("fact") == F.col("_fact"), "left")
    codes = [F.when(F.col("_fact").isNull(), "missing-fact")] + [F.when(F.col("_fact").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")), f"differs:{c}") for c in fields]
    return both.select("page", "fact", F.explode(F.array_compact(F.array(*codes))).alias("code"))


def cross_page_conflicts(citations: DataFrame, variant: Column) -> DataFrame:
    """(page, fact, n_variants): every page that cites a fact which pages cite in two ways or more."""
    named = citations.select("page", "fact", variant.alias("_v")).distinct()
    n = named.groupBy(F.col("fact").alias("_fact")).agg(F.countDistinct("_v").alias("n_variants")).filter("n_variants > 1")
    return named.select("page", "fact").distinct().join(n, F.col("fact") == F.col("_fact")).drop("_fact")


def source_integrity(provider: Column, given_class: Column, given_scope: Column) -> Column:
    """(source_class, claim_scope): what is declared, else by the provider, and the scope by the class."""
    guessed = F.when(provider == "official-website", "official-location").when(provider == "manual", "manual-first-party").when(provider == "osm", "open-data").otherwise("third-party")
    kind = F.coalesce(given_class, guessed)
    scope = F.coalesce(given_scope, F.when(kind == "official-brand", "brand").otherwise("establishment"))
    return F.struct(kind.alias("source_class"), scope.alias("claim_scope"))


def local_sources(sources: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows (…, source) whose source isn't known to speak for a whole brand; unknown sources stay."""
    brand = scopes.filter("claim_scope = 'brand'").select("source").distinct()
    return sources.join(brand, "source", "left_anti")


def operational_status(signals: DataFrame, now: str) -> DataFrame:
    """(entity, status, needs_verification, reasons) from signals (entity, status, accepted, source_class, observed).

    Accepted signals of an official place or a visitor that are at most FRESH_DAYS old decide
    if they agree.
    """
    age = F.datediff(F.lit(now).cast("date"), F.try_to_date(F.substring("observed", 1, 10), "yyyy-MM-dd"))
    trusted = F.col("accepted") & F.col("source_class").isin("official-location", "manual-first-party") & age.between(0, FRESH_DAYS)
    known = F.when(F.coalesce(trusted, F.lit(False)), F.col("status"))
    taken = F.when(F.col("accepted"), F.col("status"))
    one = signals.groupBy("entity").agg(F.count("*").alias("n"), F.count(taken).alias("n_accepted"), F.min(taken).alias("a"), F.max(taken).alias("b"), F.min(known).alias("lo"), F.max(known).alias("hi"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("lo") != F.col("hi"), "contradictory-current"),
            F.when(F.col("n_accepted") == 0, "none-accepted"),
            F.when((F.col("n_accepted") > 0) & F.col("lo").isNull(), "not-current"),
            F.when(F.col("a") != F.col("b"), "contradictory"),
        )
    )
    status = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("unknown")
    return one.select("entity", status.alias("status"), ((status == "unknown") | (F.size(reasons) > 0)).alias("needs_verification"), reasons.alias("reasons"))


def freshness(date: Column, now: Column, days: int) -> Column:
    """Whether a date is known and neither in the future nor too old."""
    return F.coalesce(F.datediff(now, date).between(0, days), F.lit(False))

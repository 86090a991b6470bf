"""Reads of a document store: language and drafts, slugs, bodies, references of any kind, routes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def published(docs: DataFrame, doc_id: str = "id") -> DataFrame:
    """Documents that aren't drafts."""
    return docs.filter(~F.startswith(doc_id, F.lit("drafts.")))


def base_id(doc_id: Column) -> Column:
    return F.regexp_replace(doc_id, r"^drafts\.", "")


def listed(docs: DataFrame) -> DataFrame:
    """Published Spanish documents with a slug; a missing ``no_index`` counts as false."""
    return docs.filter((F.col("language") == "es") & F.col("slug").isNotNull())


def indexed(docs: DataFrame) -> DataFrame:
    return docs.filter(~F.coalesce("no_index", F.lit(False)))


def body_text(blocks: Column) -> Column:
    """(text, style) of the text blocks of a body; the texts of a block's children are joined."""
    return F.transform(F.filter(blocks, lambda b: b["type"] == "block"), lambda b: F.struct(F.array_join(F.transform(b["children"], lambda c: F.coalesce(c["text"], F.lit(""))), "").alias("text"), b["style"].alias("style")))


def filtered(items: DataFrame, tests: dict[str, object], order: list[Column], limit: int | None = None) -> DataFrame:
    """Rows that equal all given values, and then the first ones in a given order."""
    for c, v in tests.items():
        if v is not None:
            items = items.filter(F.col(c) == F.lit(v))
    return items if limit is None else items.orderBy(*order).limit(limit)


def deref_any(df: DataFrame, ref: str, targets: list[tuple[DataFrame, str, dict[str, Column]]]) -> DataFrame:
    """Rows whose reference names a row of one of several tables, with its columns; the first table wins.

    A target is (table, key, columns); rows that name nothing are dropped.
    """
    union = None
    for k, (t, key, columns) in enumerate(targets):
        part = t.select(F.col(key).alias("_key"), F.lit(k).alias("_rank"), *[c.alias(a) for a, c in columns.items()])
        union = part if union is None else union.unionByName(part)
    names = list(targets[0][2])
    best = union.groupBy("_key").agg(F.min(F.struct("_rank", *names)).alias("_t"))
    return df.join(best, F.col(ref) == F.col("_key")).select(*df.columns, *[F.col(f"_t.{c}").alias(c) for c in names])


def references(docs: DataFrame, doc_id: str, refs: list[Column]) -> DataFrame:
    """(src, dst) of every reference that a document holds, at any depth that ``refs`` (arrays of ids) reach."""
    return docs.select(F.col(doc_id).alias("src"), F.explode(F.concat(*refs)).alias("dst")).filter("dst is not null").distinct()


def remote_state(found: DataFrame) -> DataFrame:
    """(id, type, draft, published): which versions of each wanted document exist, from rows (id, type) with and without draft prefix."""
    rows = found.select(base_id(F.col("id")).alias("base"), "type", F.startswith("id", F.lit("drafts.")).alias("d"))
    return rows.groupBy(F.col("base").alias("id")).agg(F.min("type").alias("type"), F.bool_or("d").alias("draft"), F.bool_or(~F.col("d")).alias("published"))


def reference_issues(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """(src, dst, code): references (src, dst, allowed: array of types) to nothing or to a type that isn't allowed; assets are skipped."""
    rows = refs.filter(~F.col("dst").rlike("^(image|file)-"))
    both = rows.join(docs.select(F.col("id").alias("_id"), F.col("type").alias("_type")), F.col("dst") == F.col("_id"), "left")
    code = F.when(F.col("_id").isNull(), "missing").when(~F.array_contains("allowed", F.col("_type")), "type")
    return both.select("src", "dst", code.alias("code")).filter("code is not null")


def routes(static: DataFrame, kinds: list[tuple[DataFrame, Callable[[Column], Column], str | None]]) -> DataFrame:
    """Distinct routes: fixed ones, one for each slug, and a hub for each kind that has any."""
    all_ = static.select("route")
    for docs, path, hub in kinds:
        some = docs.select(path(F.col("slug")).alias("route"))
        all_ = all_.unionByName(some)
        if hub:
            all_ = all_.unionByName(some.limit(1).select(F.lit(hub).alias("route")))
    return all_.distinct()


def phase_state(sources: list[tuple[str, Column]], default: str = "not-run") -> Column:
    """(state, origin) by the first source that has a state."""
    state = F.coalesce(*[c for _, c in sources], F.lit(default))
    origin = F.coalesce(*[F.when(c.isNotNull(), name) for name, c in sources], F.lit("none"))
    return F.struct(state.alias("state"), origin.alias("origin"))


def next_phase(states: list[tuple[str, Column]], done: tuple[str, ...] = ("PASS", "WARNING", "completed")) -> Column:
    """The first phase that isn't done; null if all are."""
    return F.coalesce(*[F.when(~c.isin(*done), name) for name, c in states])


def decided(old: DataFrame, new: DataFrame, key: str, decisions: DataFrame) -> DataFrame:
    """New candidates, and old ones that someone has decided on and that aren't among them."""
    kept = old.join(decisions.select(key).distinct(), key, "left_semi")
    return new.unionByName(kept.join(new.select(key), key, "left_anti"))


def current_decisions(events: DataFrame) -> DataFrame:
    """(id, state) from events (id, ord, action): the last of approve, dismiss, undismiss and withdraw counts.

    An imported candidate can't be withdrawn; a dismissed one can't be approved before it is
    taken up again; nothing is ever deleted.
    """
    seq = F.array_sort(F.collect_list(F.struct("ord", "action")))
    step = lambda s, e: (
        F.when((e["action"] == "approve") & s.isin("pending", "withdrawn"), "approved")
        .when((e["action"] == "dismiss") & s.isin("pending", "withdrawn"), "dismissed")
        .when((e["action"] == "undismiss") & (s == "dismissed"), "pending")
        .when((e["action"] == "withdraw") & (s == "approved"), "withdrawn")
        .when((e["action"] == "import") & (s == "approved"), "imported")
        .otherwise(s)
    )
    return events.groupBy("id").agg(seq.alias("_e")).select("id", F.aggregate("_e", F.lit("pending"), step).alias("state"))

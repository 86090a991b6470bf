"""Rules as rows: a table of predicates over nested documents or flat rows, compiled into one scan.

A rule is a row (doc_type, place, node_type, member, test, bound, severity, code). The first
three say where it holds: in documents of a type, at a place (``entries[]``; empty for the
document itself), in objects of a type; null is anywhere. ``test`` is a name of ``TESTS``,
``bound`` its parameter as text. A table of rules is read once, on the driver (a rule set is
written by people; ``MOST`` bounds it), and becomes one array of broken codes per object,
exploded once, whatever the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from datetime import date
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantera.functions.dates import strict_date
from cantera.operators.nested import ABSENT, Number, json_doubts, only

RULE = "doc_type string, place string, node_type string, member string, test string, bound string, severity string, code string"
MOST = 10_000
# The severities, worst last, and formats of dates and hours.
SEVERITIES = ("warning", "error")
DATE_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"
WEB = r"(?i)^https?://[^\s/?#]+"


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda m: F.coalesce(m["kind"] == kind, F.lit(False))


def _full(m: Column) -> Column:
    return _is("string")(m) & (F.trim(m["text"]) != "")


def _range(bound: str) -> tuple[float, float]:
    low, _, high = bound.partition("..")
    return float(low) if low else float("-inf"), float(high) if high else float("inf")


def _within(value: Column, bound: str) -> Column:
    low, high = _range(bound)
    return F.coalesce(value.between(F.lit(low), F.lit(high)), F.lit(False))


#: Each test says what breaks a rule, of a member (null where there is none) and the bound. Tests of optional members hold only if they are there.
TESTS: dict[str, Callable[[Column, str], Column]] = {
    "text": lambda m, b: ~_full(m),
    "optional-text": lambda m, b: m.isNotNull() & ~_is("string")(m),
    "optional-full-text": lambda m, b: m.isNotNull() & ~_full(m),
    "at-most": lambda m, b: _is("string")(m) & (F.length(m["text"]) > int(b)),
    "text-at-most": lambda m, b: m.isNotNull() & ~(_is("string")(m) & (F.length(m["text"]) <= int(b))),
    "one-of": lambda m, b: m.isNotNull() & ~(_is("string")(m) & m["text"].isin(*b.split("|"))),
    "required-one-of": lambda m, b: ~(_is("string")(m) & F.coalesce(m["text"].isin(*b.split("|")), F.lit(False))),
    "is": lambda m, b: ~(_is("string")(m) & (m["text"] == b)),
    "optional-is": lambda m, b: m.isNotNull() & ~(_is("string")(m) & (m["text"] == b)),
    "matches": lambda m, b: ~(_is("string")(m) & m["text"].rlike(b)),
    "optional-matches": lambda m, b: m.isNotNull() & ~(_is("string")(m) & m["text"].rlike(b)),
    "optional-boolean": lambda m, b: m.isNotNull() & ~_is("boolean")(m),
    "number": lambda m, b: ~(_is("number")(m) & _within(m["text"].try_cast("double"), b)),
    "optional-number": lambda m, b: m.isNotNull() & ~(_is("number")(m) & _within(m["text"].try_cast("double"), b)),
    "positive": lambda m, b: m.isNotNull() & ~(_is("number")(m) & F.coalesce(m["text"].try_cast("double") > 0, F.lit(False))),
    "date": lambda m, b: ~(_is("string")(m) & strict_date(m["text"]).isNotNull()),
    "optional-date": lambda m, b: m.isNotNull() & ~(_is("string")(m) & strict_date(m["text"]).isNotNull()),
    "date-time": lambda m, b: ~(_is("string")(m) & m["text"].rlike(DATE_TIME) & m["text"].try_cast("timestamp").isNotNull()),
    "optional-date-time": lambda m, b: m.isNotNull() & ~(_is("string")(m) & m["text"].rlike(DATE_TIME) & m["text"].try_cast("timestamp").isNotNull()),
    "web-address": lambda m, b: ~(_is("string")(m) & m["text"].rlike(WEB)),
    "optional-web-address": lambda m, b: m.isNotNull() & ~(_is("string")(m) & m["text"].rlike(WEB)),
    "absent": lambda m, b: m.isNotNull(),
    "object": lambda m, b: ~_is("object")(m),
    "optional-object": lambda m, b: m.isNotNull() & ~_is("object")(m),
    "reference": lambda m, b: ~(_is("object")(m) & F.coalesce(m["type"] == "reference", F.lit(False)) & m["text"].isNotNull()),
    "optional-reference": lambda m, b: m.isNotNull() & ~(_is("object")(m) & F.coalesce(m["type"] == "reference", F.lit(False)) & m["text"].isNotNull()),
    "list": lambda m, b: ~(_is("array")(m) & _within(m["size"], b or "..")),
    "optional-list": lambda m, b: m.isNotNull() & ~_is("array")(m),
    "texts": lambda m, b: ~(_is("array")(m) & _within(m["size"], b or "..") & F.coalesce(m["items"] == "string", m["size"] == 0) & (m["blanks"] == 0)),
    "optional-texts": lambda m, b: m.isNotNull() & ~(_is("array")(m) & F.coalesce(m["items"] == "string", m["size"] == 0) & (m["blanks"] == 0)),
    "strings": lambda m, b: ~(_is("array")(m) & _within(m["size"], b or "..") & F.coalesce(m["items"] == "string", m["size"] == 0)),
    "unique": lambda m, b: F.lit(False),  # looks at several objects, see ``violations``
    "objects": lambda m, b: _is("array")(m) & ~F.coalesce(m["items"] == "object", m["size"] == 0),
}


#: Tests that a missing member never breaks.
OPTIONAL = frozenset(t for t in TESTS if t.startswith("optional-")) | {"at-most", "text-at-most", "one-of", "positive", "absent", "unique", "objects"}
#: Expressions that Java and Python read alike, on printable ASCII texts: sets without sets in them, groups, lookahead, counts.
ALIKE = re.compile(r"(?:\(\?i\))?(?:\\[.dsw/-]|\[\^?(?:\\[.dsw/-]|[A-Za-z0-9_.,/?#:@ -])+\]|\((?:\?[!=:])?|\{\d+(?:,\d*)?\}|[A-Za-z0-9_/:@,#= .^$|)*+?-])+")


def _matcher(pattern: str) -> Callable[[object], bool]:
    """Whether a text surely matches; never for an expression that isn't ``ALIKE``."""
    if not ALIKE.fullmatch(pattern):
        return lambda v: False
    search = re.compile(pattern, re.ASCII).search
    return lambda v: type(v) is str and v.isascii() and v.isprintable() and search(v) is not None


def _day(v: object) -> bool:
    if type(v) is not str or not re.fullmatch(r"\d{4}-\d\d-\d\d", v, re.ASCII):
        return False
    try:
        return date.fromisoformat(v) is not None
    except ValueError:
        return False


def _each(good: Callable[[object], bool], low: float, high: float) -> Callable[[object], bool]:
    def sure(v: object) -> bool:
        if type(v) is not list or not low <= len(v) <= high:
            return False
        for x in v:
            if not good(x):
                return False
        return True

    return sure


def cleared(test: str, bound: str | None) -> Callable[[object], bool]:
    """What tells cheaply, of a parsed value or ``ABSENT``, that it surely doesn't break a test; what isn't cleared is for ``TESTS`` to judge."""
    text = lambda v: type(v) is str
    filled = lambda v: type(v) is str and v.strip() != ""
    kind = test.removeprefix("optional-")
    if kind == "unique":
        return only
    elif kind in ("at-most", "text-at-most"):
        most = int(bound)
        sure = lambda v: len(v) <= most if type(v) is str else kind == "at-most"
    elif kind in ("one-of", "required-one-of", "is"):
        wanted = frozenset([bound] if kind == "is" else bound.split("|"))
        sure = lambda v: type(v) is str and v in wanted
    elif kind in ("matches", "web-address"):
        sure = _matcher(WEB if kind == "web-address" else bound)
    elif kind == "number":
        low, high = _range(bound)
        sure = lambda v: type(v) is Number and low <= float(v) <= high
    elif kind in ("list", "texts", "strings"):
        low, high = _range(bound or "..") if test != "optional-list" and test != "optional-texts" else _range("..")
        sure = (lambda v: type(v) is list and low <= len(v) <= high) if kind == "list" else _each(filled if kind == "texts" else text, low, high)
    else:
        each = _each(lambda x: type(x) is dict, *_range(".."))
        sure = {
            "text": text if test == "optional-text" else filled, "full-text": filled, "boolean": lambda v: isinstance(v, bool), "positive": lambda v: type(v) is Number and float(v) > 0, "date": _day, "object": lambda v: type(v) is dict,
            "reference": lambda v: type(v) is dict and v.get("_type") == "reference" and type(v["_type"]) is str and type(v.get("_ref")) is str, "objects": lambda v: type(v) is not list or each(v),
        }.get(kind, lambda v: False)
    return (lambda v: v is ABSENT or sure(v)) if test in OPTIONAL else sure


def rules_of(table: DataFrame) -> list[tuple[str | None, ...]]:
    """The rules of a table with the columns of ``RULE``; an unknown test or severity is an error, as is a table beyond ``MOST``."""
    rows = [tuple(r) for r in table.select(*[c.split()[0] for c in RULE.split(", ")]).limit(MOST + 1).collect()]
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rules")
    return checked(rows)


def checked(rules: Iterable[tuple[str | None, ...]]) -> list[tuple[str | None, ...]]:
    rules = list(rules)
    for *_, test, _, severity, code in rules:
        if test not in TESTS or severity not in SEVERITIES or not code:
            raise ValueError(f"unknown test, severity or code: {test}, {severity}, {code}")
    return rules


def violations(nodes: DataFrame, rules: Iterable[tuple[str | None, ...]], keys: list[str]) -> DataFrame:
    """(keys, path, code, severity): a row for each rule that an object of ``json_walk`` breaks; path leads to the member.

    Rules are grouped by where they hold, so that an object is put to the tests of its own
    scopes only. ``unique`` breaks for a text or reference that an earlier object at the same
    place of the document has; only broken rules and these texts are shuffled. A text that
    isn't JSON breaks ``json``.
    """
    scopes: dict[tuple, list[Column]] = {}
    hit = lambda path, code, severity, text=None: F.struct(path.alias("path"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(None) if text is None else text).cast("string").alias("text"))
    at = F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit(".")))
    rules = checked(rules)
    for of, where, node, member, test, bound, severity, code in rules:
        m, path = F.try_element_at("members", F.lit(member)), F.concat(at, F.lit(member))
        if test == "unique":
            broken = F.when(m["text"].isNotNull(), hit(path, code, severity, m["text"]))
        else:
            broken = F.when(F.coalesce(TESTS[test](m, bound), F.lit(False)), hit(path, code, severity))
        scopes.setdefault((of, where, node), []).append(broken)
    # By document type first, so that an object isn't held against the places of all others.
    by_type: dict[str | None, list[Column]] = {}
    for (of, *scope), broken in scopes.items():
        holds = F.lit(True)
        for want, have in zip(scope, ("place", "type"), strict=True):
            if want is not None:
                holds = (F.col(have) == want) & holds
        by_type.setdefault(of, []).append(F.when(holds, F.array_compact(F.array(*broken))))
    found = [F.when(F.col("path").isNull(), F.array(hit(F.lit(""), "json", "error")))]
    for of, some in by_type.items():
        holds = F.col("path").isNotNull() if of is None else (F.col("root_type") == of) & F.col("path").isNotNull()
        found.append(F.when(holds, F.flatten(F.array_compact(F.array(*some)))))
    # An inner explode would also ask, in a filter before it, whether there is anything to explode, and put every rule to every object once more.
    rows = nodes.select(*keys, "place", "pos", F.explode_outer(F.flatten(F.array_compact(F.array(*found)))).alias("_hit")).where("_hit is not null").select(*keys, "place", "pos", "_hit.*")
    return _repeats(rows, rules, keys).select(*keys, "path", "code", "severity")


def _repeats(rows: DataFrame, rules: list[tuple[str | None, ...]], keys: list[str]) -> DataFrame:
    """Hits, of those with a text only the ones after the first at their place."""
    if not any(r[4] == "unique" for r in rules):
        return rows
    earlier = F.row_number().over(Window.partitionBy(*keys, "place", "code", "text").orderBy("pos"))
    return rows.withColumn("_nth", earlier).where("text is null OR _nth > 1")


def issues(documents: DataFrame, rules: Iterable[tuple[str | None, ...]], key: str = "id", column: str = "json") -> DataFrame:
    """(key, path, code, severity): the same as ``violations`` of the objects of documents (key, column), without a row for each.

    The task that walks a document clears what surely breaks no rule (``cleared``) and tells
    which texts have to be unique and aren't; members in doubt become rows, and ``TESTS``
    judges these. Nothing is shuffled; documents are told apart even if their keys are equal.
    """
    rules = checked(rules)
    doubts = json_doubts(documents, column, F.col(key), [(*r[:4], partial(cleared, r[4], r[5])) for r in rules])
    by_test: dict[tuple, list[int]] = {}
    for n, r in enumerate(rules):
        by_test.setdefault(r[4:6], []).append(n)
    broken = F.col("rule").isNull()
    for (test, bound), numbers in by_test.items():
        judged = F.lit(True) if test == "unique" else F.coalesce(TESTS[test](F.col("member"), bound), F.lit(False))
        broken = F.when(F.col("rule").isin(*numbers), judged).otherwise(broken)
    said = F.when(F.col("rule").isNull(), F.struct(F.lit(None).cast("string").alias("member"), F.lit("json").alias("code"), F.lit("error").alias("severity")))
    if rules:
        said = said.otherwise(F.get(F.array(*[F.struct(F.lit(r[3]).alias("member"), F.lit(r[7]).alias("code"), F.lit(r[6]).alias("severity")) for r in rules]), F.col("rule")))
    rows = doubts.where(broken).withColumn("_said", said)
    path = F.when(F.col("rule").isNull(), "").when(F.col("path") == "", F.col("_said.member")).otherwise(F.concat("path", F.lit("."), "_said.member"))
    return rows.select(F.col("key").alias(key), path.alias("path"), "_said.code", "_said.severity")


def outcomes(found: DataFrame, documents: DataFrame, key: str, checked_: Column | None = None) -> DataFrame:
    """(key, outcome, errors, warnings) for every document: FAIL, WARNING, PASS, or SKIPPED where ``checked_`` is false."""
    counts = found.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    both = documents.select(key, (F.lit(True) if checked_ is None else F.coalesce(checked_, F.lit(False))).alias("_checked")).distinct().join(counts, key, "left").na.fill(0, ["errors", "warnings"])
    name = F.when(~F.col("_checked"), "SKIPPED").when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARNING").otherwise("PASS")
    return both.select(key, name.alias("outcome"), "errors", "warnings")


def enforced(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows of ``df``; reading one with a hard error fails with its codes."""
    hard = found.where("severity = 'error'").groupBy(F.col(key).alias("_of")).agg(F.array_join(F.array_sort(F.collect_set("code")), ", ").alias("_codes"))
    both = df.join(hard, F.col(key).eqNullSafe(F.col("_of")), "left")
    message = F.concat(F.lit("hard errors in "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(": "), F.col("_codes"))
    return both.where(F.when(F.col("_codes").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True)).drop("_of", "_codes")

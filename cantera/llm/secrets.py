"""Secret scans with a trigram inverted index: DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: an "or" of "and"s of
trigrams, one of which any match must contain (letters folded to lower case). The index has
a posting (trigram, text) for the trigrams of the queries; postings are intersected per
"and" and united per rule, and only candidate texts are verified with the expression. A
rule without mandatory trigrams scans every text.

Texts are named by a 64-bit hash in the index; a collision only makes a candidate more.
Places are code points: the pieces between the matches and the matches alternate, so their
lengths add up to the offsets.

Defined results: a null text counts as empty and has no spans; equal texts share their
postings and are each reported; repeated rows are kept.
"""

from __future__ import annotations


from re import _constants as kind_of
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded, table, written


class Rule(NamedTuple):
    """An expression, and the group whose length must reach ``least`` (0: the whole match)."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


# The kinds in their order, base kinds first.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
N_BASE = 3

#: Members of a character class that are told apart; ways through an expression.
CLASS_SIZE = 8
WAYS = 256


def trigram_query(regex: str) -> list[frozenset[str]]:
    """"Or" of "and"s of folded trigrams that every match meets; empty if there is none."""
    ways = _walk(parser.parse(regex), [(frozenset(), "")])
    found = {grams for grams, _ in ways}
    if any(not grams for grams in found):
        return []
    return sorted((g for g in found if not any(h < g for h in found)), key=sorted)


def _walk(items, ways: list[tuple[frozenset[str], str]]) -> list[tuple[frozenset[str], str]]:
    """Ways so far, each with its trigrams and the literal text that it ends with."""
    for op, arg in items:
        if op is kind_of.LITERAL:
            ways = [_add(w, chr(arg)) for w in ways]
        elif op is kind_of.IN and (chars := _members(arg)):
            ways = [_add(w, c) for w in ways for c in chars]
        elif op is kind_of.SUBPATTERN:
            ways = _walk(arg[-1], ways)
        elif op is kind_of.BRANCH:
            ways = [w for branch in arg[1] for w in _walk(branch, ways)]
        elif op in (kind_of.MAX_REPEAT, kind_of.MIN_REPEAT) and arg[:2] == (0, 1):
            ways = ways + _walk(arg[2], ways)
        elif op in (kind_of.MAX_REPEAT, kind_of.MIN_REPEAT) and arg[0] > 0 and _members_of(arg[2]) is None:
            ways = [(g, "") for g, _ in _walk(arg[2], ways)]
        else:
            ways = [(g, "") for g, _ in ways]
        ways = list(dict.fromkeys(ways))
        if len(ways) > WAYS:  # what is common to all of them is still mandatory
            ways = [(frozenset.intersection(*(g for g, _ in ways)), "")]
    return ways


def _add(way: tuple[frozenset[str], str], c: str) -> tuple[frozenset[str], str]:
    text = (way[1] + c.lower())[-3:]
    return (way[0] | {text} if len(text) == 3 else way[0]), text


def _members(arg) -> list[str] | None:
    out = [chr(x) for op, x in arg if op is kind_of.LITERAL]
    return out if len(out) == len(arg) <= CLASS_SIZE else None


def _members_of(items) -> str | None:
    """A marker for units that are one open class; such a repeat has no literal."""
    return "class" if len(items) == 1 and items[0][0] is kind_of.IN and _members(items[0][1]) is None else None


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, ref): which texts have which trigrams."""
    low = docs.select(F.xxhash64("text").alias("ref"), F.lower("text").alias("low"))
    have = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("ref", F.explode(have).alias("gram")).distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(ref, mask): texts with a bit for each rule that they may match."""
    spark = docs.sparkSession
    asked = [(k, n, g, len(grams)) for k, r in enumerate(rules) for n, grams in enumerate(trigram_query(r.regex)) for g in sorted(grams)]
    if not asked:
        return None
    index = written(postings(docs, sorted({g for _, _, g, _ in asked})), "postings")
    query = spark.createDataFrame(asked, "rule int, clause int, gram string, size int")  # a row for each trigram of the rules
    met = index.join(F.broadcast(query), "gram").groupBy("ref", "rule", "clause", "size").agg(F.count("*").alias("n")).filter("n = size")
    return written(met.groupBy("ref").agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("mask")), "candidates")


def _spans(text: Column, rule: Rule, k: int) -> Column:
    """array<struct<start, kind, end>> of one rule's matches."""
    regex = F.lit(rule.regex)
    zipped = F.arrays_zip(F.regexp_extract_all(text, regex, 0).alias("hit"), F.split(text, rule.regex, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(rule.group)).alias("part"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), F.lit(k).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))
    return F.aggregate(F.filter(zipped, lambda x: x["hit"].isNotNull()), first, step, lambda acc: acc["out"])


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found): every document's spans in order of start, then kind."""
    body = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    found = candidates(body, rules)
    full = sum(1 << k for k, r in enumerate(rules) if not trigram_query(r.regex))
    rows = body.withColumn("_ref", F.xxhash64("text"))
    if found is not None:
        rows = rows.join(bounded(found), F.col("_ref") == F.col("ref"), "left").select("doc_id", "text", (F.coalesce("mask", F.lit(0)).bitwiseOR(F.lit(full))).alias("mask"))
    else:
        rows = rows.select("doc_id", "text", F.lit(full).alias("mask"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = [F.when((F.col("mask").bitwiseAND(F.lit(1 << k)) != 0) & F.col("text").rlike(r.regex), _spans(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(rules)]
    return rows.select("doc_id", F.sort_array(F.concat(*each)).alias("found"))


def written_spans(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < N_BASE)
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(RULES[:N_BASE])],
        F.sha2(written_spans(base), 256).alias("base_sha256"),
        written_spans(F.col("found")).alias("spans"),
    )


def _rule_sql(k: int, rule: Rule) -> str:
    """One rule's spans in SQL: offsets from the lengths of matches and of what lies between."""
    regex = rule.regex.replace("'", "''")
    return f"""
  SELECT r, {k} AS k, '{rule.kind}' AS kind, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(hits[i]) AS n
  FROM (SELECT r, unnest(range(1, len(hits) + 1)) AS i, hits, gaps, parts
        FROM (SELECT r, regexp_extract_all(t, '{regex}') AS hits, string_split_regex(t, '{regex}') AS gaps, regexp_extract_all(t, '{regex}', {rule.group}) AS parts FROM d))
  WHERE length(parts[i]) >= {rule.least}"""


OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_rule_sql(k, rule) for k, rule in enumerate(RULES))}),
g AS (
  SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
         string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) FILTER (k < {N_BASE}) AS base,
         string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans
  FROM m GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""

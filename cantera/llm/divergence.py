"""Source divergence audit: how far the words of each source lie from its language and from other sources.

Every language keeps the terms that at least ``min_docs`` of its documents hold. A group is
a (language, source); for ``n`` occurrences among its kept terms a term has the smoothed
probability p = 1 + floor(10^9 (n + 2) / (N + 2 V)), and two probabilities differ by
f(p, q) = floor((p - q)^2 / (p + q)). All of it is exact arithmetic of 64-bit integers.

Counting: tasks count terms and documents with them over their rows and send one row per
(language, source, term); these are summed and turned into postings, one row per kept term
with its sources, which are written once.

Terms by an upper-bound search: the terms of a group fall into buckets by count. f grows
with p and falls with q, so the largest group probability and the smallest language
probability in a bucket bound it. Buckets are taken best first until they hold ``k`` terms;
these give a kth value, and every other bucket whose bound isn't strictly below it is
evaluated as well. No other term can enter or tie.

Pairs by postings: for two groups A and B, with |A| and |B| terms that occur and p0 the
probability of a term that doesn't,

    sum f = sum over A of f(p, p0_B) + sum over B of f(p0_A, p) + (V - |A| - |B|) f(p0_A, p0_B)
            + sum over shared terms of f(p_A, p_B) - f(p_A, p0_B) - f(p0_A, p_B) + f(p0_A, p0_B)

The first sums come from histograms of counts; the last from walking each posting list in
tasks, which return sums and not pairs of terms. f is symmetric, so half of the pairs do.

Defined results: null text, language and source read as ''; groups without any text or
kept term have V-based probabilities like others and rank with the value that follows (0
if V is 0); repeated rows are documents of their own; ties fall by the item's UTF-8 bytes;
an empty table gives an empty result. Very long texts are counted in slices cut between
terms. Other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, bounded, table, tidy, written

#: A term is kept by a language if so many of its documents have it.
MIN_DOCS = 10
#: Terms a group reports.
TOP = 10
#: Scale of the probabilities.
SCALE = 1_000_000_000
#: (group, term) counts that a task holds before it sends them, and bytes of a text that are split at once.
HELD = 400_000
SLICE = 1 << 20
#: Sums of pairs that a task holds before it sends them.
PAIRS_HELD = 1 << 20

# Letters A-Z fall to a-z, other ASCII letters and all bytes from 128 stay, all else separates.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, n bigint, docs bigint"
SUMS = "lang string, a int, b int, shared bigint"


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about ``SLICE`` bytes."""
    folded = text.translate(_FOLD)
    at = 0
    while len(folded) - at > SLICE:
        cut = folded.rfind(b" ", at, at + SLICE)
        cut = cut if cut > at else folded.find(b" ", at + SLICE)
        if cut < 0:
            break
        yield [t for t in folded[at:cut].split(b" ") if t]
        at = cut
    yield [t for t in (folded[at:] if at else folded).split(b" ") if t]


def _send(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        terms = list(n)
        for k in range(0, len(terms), 1 << 16):
            some = terms[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for batch in batches:
        lang, source, text = (batch.column(k) for k in range(3))
        text = text.cast(pa.binary() if text.type == pa.string() else pa.large_binary())
        for k in range(len(lang)):
            key = (lang[k].as_py(), source[k].as_py())
            n, docs = held.get(key) or held.setdefault(key, (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in slices(text[k].as_py()):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            if k % 64 == 0 and sum(len(n) for n, _ in held.values()) > HELD:
                yield from _send(held)
                held = {}
    yield from _send(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents that have it."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = rows.mapInArrow(tidy(_count), COUNTS)
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, held): a kept term with its occurrences and the (source, n) that have it."""
    found = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("held"))
    return written(found.where(F.col("docs") >= min_docs).drop("docs"), "postings")


def probability(n: Column, whole: Column) -> Column:
    """1 + floor(10^9 (n + 2) / whole) by long division in three steps, so that no product leaves 64 bits."""
    rest, out = n + 2, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + _div(rest, whole), rest % whole
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def groups(docs: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: each group with id, V, terms that occur and denominator; each language with V and denominator.

    Ids count from 0 by source within a language.
    """
    names = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = flat(kept).groupBy("lang", "source").agg(F.sum("n").alias("N"), F.count("*").alias("terms"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("V"), F.sum("total").alias("N"))
    langs = written(langs.select("lang", "V", F.greatest(F.col("N") + 2 * F.col("V"), F.lit(1)).alias("whole")), "langs")
    found = names.join(sums, ["lang", "source"], "left").join(langs.select("lang", "V"), "lang", "left").na.fill(0, ["N", "terms", "V"])
    found = found.select("lang", "source", "V", "terms", F.greatest(F.col("N") + 2 * F.col("V"), F.lit(1)).alias("whole"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("id"))
    return written(found, "groups"), langs


def flat(kept: DataFrame) -> DataFrame:
    """(lang, term, total, source, n), one row for each source of a posting list."""
    return kept.select("lang", "term", "total", F.inline("held"))


def bucket(n: Column) -> Column:
    """Counts below 128 by themselves, larger ones by their power of two and six bits more."""
    e = F.greatest(F.floor(F.log2(n)).cast("int") - 6, F.lit(0))
    return (e * 64 + _div(n, F.pow(F.lit(2.0), e).cast("long"))).cast("int")


def top_terms(kept: DataFrame, by_group: DataFrame, by_lang: DataFrame, k: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the ``k`` terms of each group that stand out most above the language."""
    of = bounded(by_group.select("lang", "source", F.col("whole").alias("own")))
    rows = flat(kept).join(bounded(by_lang.select("lang", F.col("whole").alias("all"))), "lang").join(of, ["lang", "source"])
    rows = rows.select("lang", "source", "term", bucket(F.col("n")).alias("bucket"), probability(F.col("n"), F.col("own")).alias("p"), probability(F.col("total"), F.col("all")).alias("q"))
    rows = rows.where("p > q")
    buckets = rows.groupBy("lang", "source", "bucket").agg(divergence(F.max("p"), F.min("q")).alias("bound"), F.count("*").alias("terms"))
    before = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = written(buckets.withColumn("before", F.coalesce(F.sum("terms").over(before), F.lit(0))), "buckets")

    def evaluated(some: DataFrame) -> DataFrame:
        return rows.join(bounded(some.select("lang", "source", "bucket")), ["lang", "source", "bucket"]).select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = written(evaluated(buckets.where(F.col("before") < k)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "first_terms")
    kth = first.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
    more = written(buckets.where(F.col("before") >= k).join(kth, ["lang", "source"]).where("bound >= kth"), "more_buckets")
    found = first.drop("rank").unionByName(evaluated(more))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the shared terms of each pair of groups a < b of a language."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // (p + q)

    langs: dict[str, int] = {}
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def send() -> pa.RecordBatch:
        names = list(langs)
        return pa.RecordBatch.from_arrays([pa.array([names[x] for x in keys >> 44], pa.string()), pa.array((keys >> 22 & 0x3FFFFF).astype(np.int32)), pa.array((keys & 0x3FFFFF).astype(np.int32)), pa.array(sums)], ["lang", "a", "b", "shared"])

    for batch in batches:
        lists = batch.column(1)
        ids, p, p0 = (lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        lang = np.array([langs.setdefault(x, len(langs)) for x in batch.column(0).to_pylist()], np.int64)
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        at, d = np.arange(len(row)), 0
        parts = [(keys, sums)]
        while len(at):
            d += 1
            at = at[at + d < len(row)]
            at = at[row[at + d] == row[at]]
            to = at + d
            parts.append((lang[row[at]] << 44 | ids[at] << 22 | ids[to], f(p[at], p[to]) - f(p[at], p0[to]) - f(p0[at], p[to]) + f(p0[at], p0[to])))
            if sum(len(x) for x, _ in parts) > PAIRS_HELD or not len(at):
                keys, place = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, place, np.concatenate([x for _, x in parts]))
                parts = [(keys, sums)]
        if len(keys) > PAIRS_HELD:
            yield send()
            keys, sums = keys[:0], sums[:0]
    if len(keys):
        yield send()


def pairs(kept: DataFrame, by_group: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language with the sum of f over all kept terms."""
    few = by_group.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    small = F.broadcast if few else lambda df: df
    zero = probability(F.lit(0).cast("long"), F.col("whole"))
    g = by_group.withColumn("p0", zero)
    maps = g.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("id", "whole", "p0")))).alias("of"))
    lists = kept.where(F.size("held") > 1).join(small(maps), "lang")
    one = lambda h: F.struct(F.col("of")[h["source"]]["id"].alias("id"), probability(h["n"], F.col("of")[h["source"]]["whole"]).alias("p"), F.col("of")[h["source"]]["p0"].alias("p0"))
    shared = lists.select("lang", F.sort_array(F.transform("held", one)).alias("held")).mapInArrow(tidy(_shared), SUMS).groupBy("lang", "a", "b").agg(F.sum("shared").alias("shared"))

    hist = flat(kept).join(small(g.select("lang", "source", "id", "whole")), ["lang", "source"]).groupBy("lang", F.col("id").alias("a"), probability(F.col("n"), F.col("whole")).alias("p")).agg(F.count("*").alias("m"))
    other = g.select("lang", F.col("id").alias("b"), F.col("p0").alias("q"))
    sides = hist.join(small(other), "lang").where("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("m") * divergence(F.col("p"), F.col("q"))).alias("side"))
    sides = written(sides, "pair_sides")

    left = g.select("lang", "source", "V", F.col("id").alias("a"), F.col("terms").alias("ta"), F.col("p0").alias("pa"))
    right = g.select("lang", F.col("source").alias("item"), F.col("id").alias("b"), F.col("terms").alias("tb"), F.col("p0").alias("pb"))
    grid = left.join(right, "lang").where("a <> b").withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    grid = grid.join(sides, ["lang", "a", "b"], "left").join(sides.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("side").alias("back")), ["lang", "a", "b"], "left")
    grid = grid.join(shared.withColumnsRenamed({"a": "lo", "b": "hi"}), ["lang", "lo", "hi"], "left").na.fill(0, ["side", "back", "shared"])
    value = F.col("side") + F.col("back") + F.col("shared") + (F.col("V") - F.col("ta") - F.col("tb")) * divergence(F.col("pa"), F.col("pb"))
    found = grid.select("lang", "source", "item", F.when(F.col("V") > 0, value).otherwise(0).alias("value"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, k: int = TOP, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (lang, source, text): parts ``pair`` and ``term``."""
    kept = postings(docs, min_docs)
    by_group, by_lang = groups(docs, kept)
    out = pairs(kept, by_group).withColumn("part", F.lit("pair")).unionByName(top_terms(kept, by_group, by_lang, k).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS V, sum(total) AS N FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
own AS (SELECT lang, source, sum(n) AS N FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(own.N, 0) + 2 * langs.V))::HUGEINT AS p,
    (1 + (1000000000::HUGEINT * (k.total + 2)) // (langs.N + 2 * langs.V))::HUGEINT AS q
  FROM g JOIN langs USING (lang) JOIN kept k USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(max(s.v), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source AS a, y.source AS b, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS v
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL
  ) s ON s.lang = a.lang AND s.a = a.source AND s.b = b.source GROUP BY ALL
), term AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""

"""Exact Jaccard self-join of word-shingle sets by universe partition and pigeonhole.

Two sets of sizes a and b link if 100 * intersection >= 75 * union; then they differ in at
most h = (a + b) // 7 shingles. Size bands: level j serves the pairs with
K[j-1] < h <= K[j] and cuts the universe of shingle hashes into equal segments, in one of
two ways.

* Plain: more than K[j] segments, of which a set indexes the hash of its subset in each that
  isn't empty. If it has more than h of them, a linked set equals it in one. A set with
  fewer (short sets mostly) also indexes its empty segments, which meet those of all other
  such sets. Some segments are spare: a set probes as many as the pigeonhole needs, those
  with the fewest members; a frequent passage is indexed, but hardly probed.
* Neighbourhood: half as many segments, of which a set indexes its subset and every
  one-deletion of it. Two linked sets differ in one shingle at most in some segment, and so
  share a subset or one set's subset is a one-deletion of the other's.

Cost-based allocation: each set counts, at each of its levels, its signatures either way,
and those of empty subsets, which meet for no reason. A level takes the cheaper way by its
signatures plus the pairs that the empty subsets of all its sets would make (``allocation``).

Links without all pairs: groups are compared as stars first, then across components only
(see ``linking``), and pairs whose parity sketches differ in too many cells are left out
before their sets are fetched and compared exactly. Equal sets are one class throughout.

Defined results: rows with null, empty or blank text have the empty set and link with
nothing; rows may repeat; component ids are the smallest non-null id of the component.
Sets are compared as sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .linking import linked, shared_sigs, with_groups
from .shared import bounded, discard, fresh, table, tidy, written
from .shingles import mix, shingle_sets

PERCENT = 75
#: Growth of the pairs' differences from one level to the next, and spare segments.
RATIO = 1.5
SPARE = 1.2
#: Cost of a signature, which is hashed, dealt and sorted, and of a pair that is compared.
SIG_COST = 1.0
PAIR_COST = 1.0
#: Differences up to which levels may index neighbourhoods; beyond, a set has few empty segments and more shingles than segments.
NEAR_MOST = 16

#: Longs of a set's parity sketch.
WORDS = 32
#: Bits of a signature that hold its level.
LEVEL_BITS = 6


def levels() -> tuple[np.ndarray, np.ndarray]:
    """Most differences, and plain segments, of each level."""
    most = [0, 1]
    while len(most) < 1 << LEVEL_BITS and most[-1] < 1 << 40:
        most.append(max(most[-1] + 1, int(most[-1] * RATIO)))
    k = np.array(most, np.int64)
    return k, np.ceil((k + 1) * SPARE).astype(np.int64) + 1


def segments_near(most: int) -> int:
    """Segments of a level that indexes neighbourhoods: sets with so many differences differ in one at most in some segment."""
    return most // 2 + 1


def differences(total: int, percent: int) -> int:
    """Most shingles in which two linked sets of this total size differ."""
    return total * (100 - percent) // (100 + percent)


def bands(n: int, percent: int, most: np.ndarray) -> tuple[range, int]:
    """Levels at which a set of n shingles meets its partners, and its most differences."""
    least = differences(n + -(-n * percent // 100), percent)
    upper = differences(n + n * 100 // percent, percent)
    return range(max(1, int(np.searchsorted(most, least))), int(np.searchsorted(most, upper)) + 1), upper


def _cells(s: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each shingle; they ascend."""
    return ((s >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32) if segments < 1 << 31 else s >> np.uint64(33)


def subsets(s: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, hash of the subset) for each segment that isn't empty."""
    cell = _cells(s, segments)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    return cell[first], np.add.reduceat(mix(s), first)


def _named(cell: np.ndarray, value: np.ndarray, level: int) -> np.ndarray:
    """Signatures with the level in the low bits."""
    sig = mix(mix(value + np.uint64(level)) ^ (cell * np.uint64(0x9E3779B97F4A7C15)))
    low = np.uint64((1 << LEVEL_BITS) - 1)
    return (sig & ~low) | np.uint64(level)


def _with_empty(cell: np.ndarray, value: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    empty = np.setdiff1d(np.arange(segments, dtype=np.uint64), cell, assume_unique=True)
    return np.concatenate((cell, empty)), np.concatenate((value, np.zeros(len(empty), np.uint64)))


def signatures(s: np.ndarray, level: int, segments: int, need: int) -> np.ndarray:
    """Plain signatures at a level."""
    cell, value = subsets(s, segments)
    if len(cell) < need:
        cell, value = _with_empty(cell, value, segments)
    return _named(cell, value, level)


def neighbourhood(s: np.ndarray, level: int, segments: int) -> np.ndarray:
    """Signatures at a level of the set's subsets and of their one-deletions."""
    cell, value = subsets(s, segments)
    less = np.repeat(value, np.diff(np.append(np.searchsorted(_cells(s, segments), cell), len(s)))) - mix(s)
    cells, values = _with_empty(cell, value, segments)
    return np.unique(_named(np.concatenate((cells, _cells(s, segments))), np.concatenate((values, less)), level))


def costs(s: np.ndarray, most: int, segments: int, need: int) -> list[int]:
    """Signatures and those of empty subsets that a set would index, plain and with neighbourhoods."""
    out = []
    for m in (segments, segments_near(most)):
        held = np.bincount(_cells(s, m).astype(np.int64), minlength=m)
        full = int((held > 0).sum())
        if m == segments and full >= need:
            out += [full, 0]
        elif m == segments:
            out += [m, m - full]
        else:
            out += [m + len(s), m - full + int((held == 1).sum())]
    return out


def allocation(sums: dict[int, list[int]], most: np.ndarray, segments: np.ndarray) -> set[int]:
    """The levels that index neighbourhoods, from the sums of ``costs`` over all sets of a level."""
    out = set()
    for j, (plain, plain_empty, deep, deep_empty) in sums.items():
        ways = [SIG_COST * n + PAIR_COST * e * e / (2 * m) for n, e, m in ((plain, plain_empty, int(segments[j])), (deep, deep_empty, segments_near(int(most[j]))))]
        if ways[1] < ways[0]:
            out.add(j)
    return out


def set_key(s: np.ndarray) -> int:
    """Content hash of a set; a signed long."""
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64).view(np.int64))


def parities(s: np.ndarray) -> bytes:
    """Parity of the set's members in each of 64 * WORDS cells; two sets' parities differ in no more cells than the sets in members."""
    odd = np.bincount((s & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


ROWS = "th bigint, key bigint, n bigint, levels array<int>, spare array<int>, costs array<array<int>>, sketch binary"


def _describe(percent: int):
    most, segments = levels()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, size, at, spare, cost, sketch = [], [], [], [], [], []
            for s in shingle_sets(batch.column(2)):
                n = len(s)
                size.append(n)
                sketch.append(parities(s))
                key.append(set_key(s) if n else None)
                js, upper = bands(n, percent, most) if n else ((), 0)
                at.append(list(js))
                need = [int(min(most[j], upper)) + 1 for j in js]
                spare.append([max(0, len(subsets(s, int(segments[j]))[0]) - k) for j, k in zip(js, need, strict=True)])
                cost.append([costs(s, int(most[j]), int(segments[j]), k) if most[j] <= NEAR_MOST else [0] * 4 for j, k in zip(js, need, strict=True)])
            cols = [batch.column(0), batch.column(1), pa.array(key, pa.int64()), pa.array(size, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(spare, pa.list_(pa.int32())), pa.array(cost, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sketch, pa.binary())], ["id", "th", "key", "n", "levels", "spare", "costs", "sketch"])

    return run


def _index(percent: int, deep: set[int]):
    most, segments = levels()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of a task are indexed once
        for batch in batches:
            sigs, keys, held = [], [], 0
            for s in shingle_sets(batch.column(0)):
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                js, upper = bands(len(s), percent, most)
                for j in js:
                    sig = neighbourhood(s, j, segments_near(int(most[j]))) if j in deep else signatures(s, j, int(segments[j]), int(min(most[j], upper)) + 1)
                    sigs.append(sig.view(np.int64))
                    keys.append(np.full(len(sig), key, np.int64))
                    held += len(sig)
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(keys))], ["sig", "key"])
                    sigs, keys, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(keys))], ["sig", "key"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        keys, values = [], []
        for s in shingle_sets(batch.column(0)):
            if len(s) and (key := set_key(s)) not in seen:
                seen.add(key)
                keys.append(key)
                values.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.binary())], ["key", "items"])


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes that link; only the sets of classes in pairs are made and moved."""
    wanted = pairs.select(F.col("ta").alias("_th")).unionByName(pairs.select(F.col("tb").alias("_th"))).distinct()
    wanted = written(wanted, "wanted")
    texts = docs.select("text", F.xxhash64("text").alias("_h")).join(bounded(wanted), F.col("_h") == F.col("_th"), "left_semi").select("text")
    sets = texts.mapInArrow(tidy(_sets), "key bigint, items binary").groupBy("key").agg(F.first("items").alias("items"))
    sets = written(sets, "sets")
    left = sets.select(F.col("key").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("items").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(_linked(percent)), "a bigint, b bigint")


def _allocated(classes: DataFrame) -> set[int]:
    """Levels that index neighbourhoods; a row of sums for each short level comes to the driver."""
    most, segments = levels()
    each = classes.select(F.explode(F.arrays_zip("levels", "costs")).alias("c")).select(F.col("c.levels").alias("level"), *[F.col("c.costs")[k].alias(f"c{k}") for k in range(4)])
    sums = each.filter(F.col("c0") > 0).groupBy("level").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(4)]).collect()
    return allocation({r["level"]: [r[f"c{k}"] for k in range(4)] for r in sums}, most, segments)


def _grouped(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """(id, th, n, root, first): every row's group and its group's first (without id, id, th)."""
    body = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = body.schema["id"].dataType.simpleString()
    rows = body.select("id", F.xxhash64("text").alias("th"), "text").mapInArrow(tidy(_describe(percent)), f"id {kind}, {ROWS}")
    rows = written(rows, "rows")
    also = ["n", "levels", "spare", "costs", "sketch"]
    classes = written(rows.filter("n > 0").groupBy("key").agg(F.min("th").alias("th"), *[F.first(c).alias(c) for c in also]), "classes")
    deep = _allocated(classes)

    sigs = body.select("text").mapInArrow(tidy(_index(percent, deep)), "sig bigint, key bigint")
    groups = written(shared_sigs(sigs), "groups")

    # Probes: all subsets of a set but the most frequent ones, as far as its slack goes; all signatures of neighbourhoods.
    bits = (1 << LEVEL_BITS) - 1
    level = F.col("sig").bitwiseAND(F.lit(bits)).cast("int")
    spare = classes.select("key", "n", "th", F.explode(F.arrays_zip("levels", "spare")).alias("s"))
    spare = spare.select("key", "n", "th", F.col("s.levels").alias("level"), F.when(F.col("s.levels").isin(deep), 0).otherwise(F.col("s.spare")).alias("spare"))
    ranked = with_groups(groups, level).withColumn("level", level).join(spare, ["key", "level"])
    rank = F.row_number().over(Window.partitionBy("key", "level").orderBy(F.desc("g"), "sig"))
    probes = ranked.withColumn("probe", rank > F.col("spare")).groupBy(F.col("group").alias("sig"), "key", "level").agg(F.bool_or("probe").alias("probe"), *[F.first(c).alias(c) for c in ("g", "n", "th")])
    most, _ = levels()
    bound = lambda k: F.get(F.array(*[F.lit(int(m)) for m in most]), k)
    members = written(probes.withColumn("lo", bound(F.col("level") - 1)).withColumn("hi", bound(F.col("level"))).drop("level"), "members")
    discard(groups)

    def near(a, b, lo, hi):
        # As large as a link allows, and with as many differences at most as the level serves.
        apart = (a + b) * (100 - percent)
        return (b * percent <= a * 100) & (apart < (hi + 1) * (100 + percent)) & (apart >= (lo + 1) * (100 + percent))

    def close(na, nb, sa, sb):
        apart = np.bitwise_count(sa ^ sb).sum(1, dtype=np.int64)
        return apart * (100 + percent) <= (na + nb) * (100 - percent)

    sketch = classes.select("key", F.col("n").alias("size"), "sketch")
    roots = linked(members, near, lambda pairs: _verify(pairs, body, percent), sketch, close).select(F.col("node").alias("_node"), "root")
    joined = rows.select("id", "th", "n", "key").join(roots, F.col("key") == F.col("_node"), "left").select("id", "th", "n", F.coalesce("root", "key").alias("root"))
    joined = written(joined, "joined")
    place = F.struct(F.col("id").isNull().alias("without"), "id", "th")
    least = joined.filter("root is not null").groupBy("root").agg(F.min(place).alias("first")).withColumnRenamed("root", "_root")
    return joined.join(least, F.col("root") == F.col("_root"), "left").drop("_root")


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n, component) for every row of ``docs``."""
    return _grouped(docs, doc_id, text, percent).select("id", "n", F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id")).alias("component"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each group of linked or equal documents: that with the smallest id, then text hash.

    Documents without words stay. Only ids and hashes of what goes are joined to the texts.
    """
    found = _grouped(docs, doc_id, text, percent).filter("n > 0").withColumn("stays", F.struct(F.col("id").isNull().alias("without"), "id", "th") == F.col("first"))
    th, mark, other, hashed = fresh(docs, "_th", "_mark", "_other", "_hashed")
    marks = found.groupBy(F.col("id").alias(other), F.col("th").alias(hashed)).agg(F.bool_and("stays").alias(mark), F.count("*").alias("n"))
    marks = bounded(written(marks.filter(~F.col(mark) | (F.col("n") > 1)).drop("n"), "marks"))
    rows = docs.withColumn(th, F.xxhash64(F.col(f"`{text}`").cast("string")))
    rows = rows.join(marks, F.col(f"`{doc_id}`").eqNullSafe(F.col(other)) & (F.col(th) == F.col(hashed)), "left")
    once, twins = rows.filter(F.col(mark).isNull()), rows.filter(F.col(mark)).dropDuplicates([doc_id, th])
    return once.unionByName(twins).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))

"""Components of an index's groups without all pairs.

An index files members under signatures; two members may link if they share a signature
under which the smaller one probes. A group is first a star around the member that meets
most others in all its groups: near copies of one original meet there. Verified stars give
components, and groups within one component are done. Then members of *different*
components are compared by their sketches, in cells of bounded size, and the pairs that are
left are verified and added. No link is lost: two members that meet under a signature are either compared or already
connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, release, tidy, written


def shared_sigs(index: DataFrame) -> DataFrame:
    """Distinct (sig, key) rows, of those given, whose sig has two keys or more.

    Rows are sorted within partitions and streamed, so a frequent sig takes no memory.
    """
    return index.select("sig", "key").repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(_shared, "sig bigint, key bigint")


def _shared(batches):
    last: tuple[int, int, bool] | None = None  # sig, key, and whether it has been passed on
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if last is not None:
            sig, key = np.concatenate(([last[0]], sig)), np.concatenate(([last[1]], key))
        fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])))
        sig, key = sig[fresh], key[fresh]
        same = sig[1:] == sig[:-1]
        out = np.concatenate((same, [False])) | np.concatenate(([False], same))
        passed = bool(out[-1])
        if last is not None and last[2]:
            passed, out[0] = passed or len(out) == 1, False
        last = (int(sig[-1]), int(key[-1]), passed)
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(key[out])], ["sig", "key"])


def with_groups(index: DataFrame, *also: Column) -> DataFrame:
    """(sig, key) rows with their sig's number of keys, ``g``, and a name of its set of keys, ``group``.

    Sigs with the same keys, and the same values of ``also``, ask for the same comparisons:
    they can go on as one group.
    """
    sets = index.groupBy("sig").agg(F.count("*").alias("g"), F.bit_xor(F.xxhash64("key")).alias("_x"))
    return index.join(sets, "sig").withColumn("group", F.xxhash64("_x", "g", *also)).drop("_x")


#: Members of a cell in which pairs are compared; larger groups are cut into blocks, and each two blocks meet in a cell.
BLOCK = 2048
#: Pairs whose sketches are compared at a time.
PART = 1 << 14
#: Pairs that a task holds before it passes on the distinct ones.
HELD = 1 << 16

Near = Callable[[Any, Any, Any, Any], Any]
Close = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def sketch_rows(column: pa.Array) -> np.ndarray:
    """A row of longs for each binary of equal length."""
    column = column.cast(pa.large_binary())
    n = len(column)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint64) if n else np.zeros(0, np.uint64)
    width = len(column[0].as_py()) // 8 if n else 1
    first = column.offset * width
    return data[first : first + n * width].reshape(n, width)


def _near_stars(close: Close):
    """Of pairs with sizes and sketches, those that are close."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
                keep = close(na, nb, sketch_rows(batch.column(6)), sketch_rows(batch.column(7)))
                yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "ta", "tb"]).filter(pa.array(keep))

    return run


def _pairs(near: Near, close: Close | None):
    """Distinct pairs of members of a cell that may link; rows come sorted by cell."""

    def compared(t: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of pairs of places, in either order, those that may link."""
        keep = (t["root"][x] != t["root"][y]) & ((t["x"][x] == t["y"][x]) | (t["block"][x] != t["block"][y]))
        x, y = x[keep], y[keep]
        swap = (t["n"][x] > t["n"][y]) | ((t["n"][x] == t["n"][y]) & (t["key"][x] > t["key"][y]))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        keep = t["probe"][x] & near(t["n"][x], t["n"][y], t["lo"][x], t["hi"][x])
        x, y = x[keep], y[keep]
        if close is not None:
            parts = [(x[k : k + PART], y[k : k + PART]) for k in range(0, len(x), PART)]
            keep = [close(t["size"][a], t["size"][b], t["sketch"][a], t["sketch"][b]) for a, b in parts]
            x, y = (np.concatenate([p[side][ok] for p, ok in zip(parts, keep, strict=True)]) if parts else x for side in (0, 1))
        return np.stack((t["key"][x], t["key"][y], t["th"][x], t["th"][y]), 1)

    def distinct(found: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        rows = rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1)))] if len(rows) else rows
        return pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(4)], ["a", "b", "ta", "tb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        found, held = [], 0
        for batch in chain(batches, [None]):
            table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            t = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("sketch", "probe")}
            t["probe"] = table.column("probe").combine_chunks().to_numpy(zero_copy_only=False)
            if close is not None:
                t["sketch"] = sketch_rows(table.column("sketch").combine_chunks())
            new = (t["sig"][1:] != t["sig"][:-1]) | (t["x"][1:] != t["x"][:-1]) | (t["y"][1:] != t["y"][:-1])
            edges = np.concatenate(([0], np.flatnonzero(new) + 1, [table.num_rows]))
            last = len(edges) - 1 if batch is None else len(edges) - 2
            starts, sizes = edges[:last], np.diff(edges[: last + 1])
            # Cells of one size are compared together, as far as memory allows.
            for size in np.unique(sizes[sizes > 1]):
                x, y = np.triu_indices(size, 1)
                some = starts[sizes == size]
                step = max(1, (1 << 17) // len(x))
                for k in range(0, len(some), step):
                    at = some[k : k + step, None]
                    found.append(compared(t, (at + x).ravel(), (at + y).ravel()))
                    held += len(found[-1])
                    if held >= HELD:
                        found = [np.stack([c.to_numpy() for c in distinct(found).columns], 1)]
                        if len(found[0]) > HELD // 2:
                            yield distinct(found)
                            found = []
                        held = sum(map(len, found))
            rest = None if batch is None else table.slice(int(edges[last])).combine_chunks()
        if held:
            yield distinct(found)

    return run


PAIRS = "a bigint, b bigint, ta bigint, tb bigint"


def linked(members: DataFrame, near: Near, verify: Callable[[DataFrame], DataFrame], sketch: DataFrame | None = None, close: Close | None = None) -> DataFrame:
    """(node, root) of the linked members.

    ``members`` has sig, g (the members of sig), key, n (a size), th, probe, lo and hi, and is
    discarded. ``near`` is a necessary condition on a smaller and a larger size, lo and hi, of
    columns and of arrays; ``close`` one on the sizes and sketches of pairs, ``sketch`` having
    key, size and sketch (binary, of one length); ``verify`` takes distinct pairs (a, b, ta, tb)
    of keys and their ths and returns those that link.
    """
    score = members.groupBy(F.col("key").alias("_key")).agg(F.sum("g").alias("score"))
    known = written(members.join(score, F.col("key") == F.col("_key")).drop("_key"), "known")
    discard(members)
    heads = known.groupBy(F.col("sig").alias("_sig")).agg(F.max(F.struct("score", "key", "n", "th", "probe")).alias("h"))
    both = known.join(heads, F.col("sig") == F.col("_sig")).filter(F.col("key") != F.col("h.key"))
    lower = (F.col("n") < F.col("h.n")) | ((F.col("n") == F.col("h.n")) & (F.col("key") < F.col("h.key")))
    both = both.filter(F.when(lower, F.col("probe")).otherwise(F.col("h.probe")) & near(F.least("n", "h.n"), F.greatest("n", "h.n"), F.col("lo"), F.col("hi")))
    one, two = F.struct("key", "th"), F.struct("h.key", "h.th")
    stars = both.select(F.when(lower, one).otherwise(two).alias("p"), F.when(lower, two).otherwise(one).alias("q")).distinct()
    stars = stars.select(F.col("p.key").alias("a"), F.col("q.key").alias("b"), F.col("p.th").alias("ta"), F.col("q.th").alias("tb"))
    if sketch is not None:
        for x in "ab":
            stars = stars.join(sketch.select(F.col("key").alias("_key"), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")), F.col(x) == F.col("_key")).drop("_key")
        stars = stars.select("a", "b", "ta", "tb", "na", "nb", "sa", "sb").mapInArrow(_near_stars(close), PAIRS)
    links = written(verify(written(stars, "stars")), "links")

    roots = components(links)
    rooted = written(_rooted(known.drop("score"), roots), "rooted")
    discard(known)

    edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    cross = _crossing(rooted, sketch).mapInArrow(tidy(_pairs(near, close)), PAIRS)
    more = written(verify(written(cross.distinct(), "cross")), "more")
    discard(rooted)
    return components(edges.unionByName(more.select("a", "b")))


def linked_in_place(members: DataFrame, about: DataFrame, links: DataFrame, compare: Callable[[bool], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]) -> DataFrame:
    """(node, root) of the linked members, whose pairs are verified in the cells where they meet.

    Pairs that meet without linking may grow with the square of a group; members go to cells
    with what tells whether they link, so that no pair is shuffled or written, only links are.
    ``members`` has sig, g (the members of sig) and key, and is discarded; ``about`` has key and
    the columns that ``compare`` needs, ``links`` (a, b) what is known to link. ``compare`` takes
    rows of ``about`` with sig, x, y, block, root and alone, sorted by cell (sig, x, y) and n,
    and gives the links (a, b) between different roots: at first one pair for each two roots
    that meet, which saves most pairs of large components, then all that are left. Keys that
    nothing was linked with at first are alone; their pairs with each other have been seen then.
    """
    for first in (True, False):
        roots = components(links)
        old, members = members, written(_rooted(members.drop("root"), roots, first), "rooted")
        discard(old)
        found = written(_crossing(members, about, "n").mapInArrow(tidy(compare(first)), "a bigint, b bigint"), "more")
        release(found)
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
    discard(members)
    return components(links)


def _rooted(members: DataFrame, roots: DataFrame, alone: bool = False) -> DataFrame:
    """Members with the root of their component, themselves if they have none; groups within one component go."""
    both = members.join(roots.withColumnRenamed("node", "_node"), F.col("key") == F.col("_node"), "left").drop("_node")
    both = (both.withColumn("alone", F.col("root").isNull()) if alone else both).withColumn("root", F.coalesce("root", "key"))
    probes = F.bool_or("probe") if "probe" in members.columns else F.lit(True)
    mixed = both.groupBy(F.col("sig").alias("_sig")).agg(F.min("root").alias("a"), F.max("root").alias("b"), probes.alias("any")).filter("a <> b and any").select("_sig")
    return both.join(mixed, F.col("sig") == F.col("_sig"), "left_semi")


def _crossing(rooted: DataFrame, about: DataFrame | None, *order: str) -> DataFrame:
    """Members of groups with several components, dealt to cells of pairs of blocks and sorted by them."""
    blocks = F.ceil(F.col("g") / BLOCK).cast("int")
    rows = rooted.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("other", "g")
    if about is not None:
        rows = rows.join(about.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key")).drop("_key")
    return rows.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y", *order)

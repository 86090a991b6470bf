"""Best-fit packing of tokenised documents into sequences by a linear grouping scheme.

A document's ids are those of a byte-level tokenizer, closed by one end id. Only documents
of more than ``capacity`` ids are cut: into pieces of exactly ``capacity``, after a first
piece with the rest.

Packing needs nothing of a piece but its length, so it is planned over the histogram of
lengths, which has at most ``capacity`` rows however large the corpus is:

1. pieces of full length are sequences of their own;
2. large lengths (from ``capacity / 3``) are put in order and cut into ``GROUPS`` groups of
   equal cardinality, each rounded up to its longest length; the linear programme over
   configurations of these few sizes is solved by column generation, with a knapsack for
   pricing, and its solution is rounded down;
3. actual pieces, from the longest of each group, are substituted into the configurations;
   as they are no longer than what they stand for, they fit, and the room they leave counts;
4. what is left of the large lengths and all small ones are put in by best fit, longest
   first: into the fullest sequences that have room for them.

Sequences that are filled alike are handled as runs, so the plan's size depends on the
lengths and not on the number of pieces. It is a table of runs: the pieces of a length from
one rank to another go to consecutive sequences, so many in each, from an offset. Tasks
rank pieces within their length, by counts of hash buckets and places within a bucket, and
look up their place. No sequence is ever put together in one task.

Defined results: null and empty texts are one piece, the end id; repeated rows are pieces
of their own; a null document id is an id; a text of any length is read in slices that end
between words, and a task holds four bytes a token of one document; an empty table gives an
empty result. Strings of special tokens in a text are ordinary text. Other columns are not
read. The vocabulary's path is a parameter; its file is read by the tasks.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from .shared import table, tidy, written
from .token_counts import PATTERN

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY = 2048
END = 0
#: Groups of large lengths, and the part of the capacity from which a length is large.
GROUPS = 160
LARGE = 3
#: Relative distance to the lower bound at which the linear programme is solved, and its steps.
GAP = 2e-4
STEPS = 3000
#: Characters of a text that are encoded at once.
SLICE = 1 << 20
#: Pieces of a hash bucket, at least.
BUCKET_ROWS = 256

# ---- tokens

#: Bytes as a byte-level vocabulary writes them: printable ones of Latin-1 as they are, the others from U+0100 on, in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    The tokenizer's file defines them. Texts of plain characters are put through its
    vocabulary by a faster encoder, which gives the same ids; a text with characters on whose
    class two regular expression engines may differ goes to the tokenizer itself.
    """

    plain = re.compile("[\x00-\x1b\x20-\x7f\xa0-\u024f\u2010-\u2027]*")
    between = re.compile("[A-Za-z](?= [A-Za-z])")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        back = {chr(letter): byte for byte, letter in LETTERS.items()}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(back[c] for c in token): rank for token, rank in self.tokenizer.get_vocab().items() if token not in special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _slice(self, text: str) -> bytes:
        if self.plain.fullmatch(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        parts, at = [], 0
        while len(text) - at > SLICE and (m := self.between.search(text, at + SLICE)):
            parts.append(self._slice(text[at : m.end()]))
            at = m.end()
        parts.append(self._slice(text[at:]))
        return b"".join(parts)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


PIECE = [StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, np.array([END], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.columns
            rows: list[tuple[int, int, int, int, int]] = []
            for k in range(len(texts)):
                buffer = memoryview(encode(texts[k].as_py() or "") + end)
                n, start = len(buffer) // 4, 0
                for piece in range(-(-n // capacity)):
                    stop = start + (capacity if piece else (n - 1) % capacity + 1)
                    rows.append((k, piece, start, stop - start, zlib.crc32(buffer[4 * start : 4 * stop])))
                    start = stop
            if rows:
                at, *columns = (np.array(c) for c in zip(*rows, strict=True))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", *[f.name for f in PIECE]])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), StructType([docs.schema["doc_id"], *PIECE]))


# ---- the plan, over the histogram of lengths


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """(copies of each size, how often) of a nearly optimal fractional packing, by column generation."""
    k = len(sizes)
    size, d = np.array(sizes), np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    price, x = np.ones(k), d / np.diag(basis)
    room = np.arange(capacity + 1)[None, :] - size[:, None]
    fits, room = room >= 0, np.maximum(room, 0)
    for _ in range(STEPS):
        y = np.linalg.solve(basis.T, price)
        if y.min() < -1e-9:  # more than is asked of this size
            column, cost = np.zeros(k), 0.0
            column[y.argmin()] = -1
        else:
            best = np.zeros(capacity + 1)
            for _ in range(capacity // min(sizes)):
                more = np.where(fits, best[room] + y[:, None], 0).max(axis=0)
                if (more <= best + 1e-15).all():
                    break
                best = np.maximum(best, more)
            value = best[capacity]
            if value <= 1 + 1e-9 or (price @ x) * (1 - GAP) <= (y @ d) / value:
                break
            column, cost, left = np.zeros(k), 1.0, capacity
            while (options := [g for g in range(k) if size[g] <= left and best[left - size[g]] + y[g] >= best[left] - 1e-12 and y[g] > 1e-15]):
                column[options[0]] += 1
                left -= sizes[options[0]]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * step, 0)
        basis[:, out], price[out], x[out] = column, cost, ratio[out]
    return [([int(c) for c in basis[:, j]], float(x[j])) for j in range(k) if price[j] > 0 and x[j] > 0]


def grouped(runs: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int, int]]]:
    """Groups of equal cardinality of the (length, count) runs, longest first, as (length, rank, count); equal maxima are one group.

    As many lengths as groups, or fewer, need no rounding.
    """
    if len(runs) <= groups:
        return [[(s, 0, n)] for s, n in runs]
    total = sum(n for _, n in runs)
    each, out, room = -(-total // groups), [], 0
    for s, n in runs:
        rank = 0
        while rank < n:
            if not room:
                if not (out and out[-1][0][0] == s):
                    out.append([])
                room = each
            take = min(room, n - rank)
            out[-1].append((s, rank, take))
            rank, room = rank + take, room - take
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, rank, first sequence, pieces a sequence, offset), and the number of sequences."""
    rows: list[tuple[int, int, int, int, int]] = []
    made = 0
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # runs of sequences by the room they have
    open_ = 0  # bit r is set if there are sequences with room r

    def leave(first: int, n: int, room: int) -> None:
        nonlocal open_
        if n and room:
            rooms[room].append((first, n))
            open_ |= 1 << room

    if histogram.get(capacity):
        rows.append((capacity, 0, 0, 1, 0))
        made = histogram[capacity]
    large = [(s, histogram[s]) for s in sorted(histogram, reverse=True) if capacity / LARGE <= s < capacity]
    rest = {s: [(0, n)] for s, n in histogram.items() if s < capacity / LARGE}
    queues = grouped(large, groups)
    found = configurations([q[0][0] for q in queues], [sum(n for *_, n in q) for q in queues], capacity) if queues else []
    for q in queues:
        q.reverse()  # the next run is the last
    for copies, times in found:
        n = int(times + 1e-6)
        some = [(made, n, 0)] if n else []  # sequences of this configuration: first, number, ids so far
        made += n
        for g in (g for g, c in enumerate(copies) for _ in range(c)):
            done = []
            while some and queues[g]:
                first, m, used = some.pop()
                s, rank, have = queues[g].pop()
                take = min(m, have)
                rows.append((s, rank, first, 1, used))
                done.append((first, take, used + s))
                if take < m:
                    some.append((first + take, m - take, used))
                if take < have:
                    queues[g].append((s, rank + take, have - take))
            some += done[::-1]
        for first, m, used in some:
            leave(first, m, capacity - used)
    for q in queues:
        for s, rank, n in q:
            rest.setdefault(s, []).append((rank, n))
    for s in sorted(rest, reverse=True):
        for rank, n in rest[s]:
            while n:
                if at := open_ >> s:
                    room = s + (at & -at).bit_length() - 1
                    first, m = rooms[room].pop()
                    if not rooms[room]:
                        open_ ^= 1 << room
                else:
                    room, first, m = capacity, made, -(-n // (capacity // s))
                    made += m
                each = min(room // s, n)
                take = min(m, n // each)
                rows.append((s, rank, first, each, capacity - room))
                leave(first, take, room - each * s)
                leave(first + take, m - take, room)
                rank, n = rank + take * each, n - take * each
    return rows, made


# ---- places


def ranked(found: DataFrame, histogram: DataFrame) -> DataFrame:
    """The pieces with their ``rank`` within their length, from 0; histogram: (length, count) with a row for each length."""
    most = histogram.agg(F.max("count")).first()[0] or 0
    size = max(BUCKET_ROWS, isqrt(most))
    keys = [c for c in found.columns]
    rows = found.join(F.broadcast(histogram.select(F.col("length").alias("of"), F.expr(f"count div {size} + 1").alias("buckets"))), F.col("length") == F.col("of"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.col("buckets"))).drop("of", "buckets")
    sums = rows.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rows = rows.withColumn("within", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*keys)))
    return rows.join(sums, ["length", "bucket"]).select(*keys, (F.col("base") + F.col("within") - 1).alias("rank"))


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, groups: int = GROUPS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of ``docs`` (doc_id, text)."""
    found = written(pieces(docs, capacity, tokenizer), "pieces")
    histogram = written(found.groupBy("length").count(), "lengths")
    rows, _ = plan({r["length"]: r["count"] for r in histogram.collect()}, capacity, groups)  # a row for each length, at most capacity
    length, rank, first, each, offset = (np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else [np.zeros(0, np.int64)] * 5
    keys = length << 48 | rank
    names = [f.name for f in found.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at = (batch.column(c).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(keys, size << 48 | at, "right") - 1
            past = at - rank[k]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(first[k] + past // each[k]), pa.array(offset[k] + past % each[k] * size)], [*names, "sequence_id", "offset"])

    schema = StructType([*found.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked(found, histogram).mapInArrow(run, schema)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))

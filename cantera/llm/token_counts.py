"""Token counts that follow edits, with a segment tree of pre-tokens per document.

A text is split into pre-tokens, which a byte-level tokenizer encodes one by one, so counts
add up. Runs of ``LEAF`` pre-tokens are the leaves of a segment tree whose nodes hold token
counts; the tree is kept as two arrays, the leaves' starts and the nodes in heap order.

An edit replaces [start, stop) code points by new text. Pre-tokens that end two or more
characters before it can't change, as the pattern looks one character ahead at most;
splitting starts again at the leaf that holds that place, and stops where a boundary falls
on an old leaf boundary behind the edit, from where on the old leaves hold. Only what lies
between is encoded, and sums on the way to the root are updated.

Defined results: a null text counts as empty, with no leaf and 0 tokens; edits are applied
in order, each to the result of the one before; places beyond the text are cut to its end;
null edits and null edit texts change nothing or insert nothing. The vocabulary's path is a
parameter; its files are read by the tasks.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .shared import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 64
#: Pre-tokens whose counts a task remembers.
CACHE = 1 << 19

# Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

TREE = StructType([StructField("starts", ArrayType(IntegerType())), StructField("nodes", ArrayType(LongType()))])
EDITED = StructType([StructField("text", StringType()), *TREE.fields, StructField("encoded", LongType())])


class Counter:
    """Tokens of pre-tokens, with a bounded memory of earlier answers."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def tokens(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            n = self.known[piece] = len(self.encode(piece))
        return n


@lru_cache(maxsize=1)
def counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


def heap(counts: list[int]) -> list[int]:
    """Nodes of the tree, root first; the leaves stand at the end, padded to a power of two."""
    width = 1 << max(0, len(counts) - 1).bit_length() if counts else 0
    nodes = [0] * (width - 1) + counts + [0] * (width - len(counts)) if width else []
    for k in range(width - 2, -1, -1):
        nodes[k] = nodes[2 * k + 1] + nodes[2 * k + 2]
    return nodes


def leaf_counts(starts: list[int], nodes: list[int]) -> list[int]:
    return nodes[len(nodes) // 2 : len(nodes) // 2 + len(starts)]


def build(text: str, c: Counter) -> tuple[list[int], list[int]]:
    pieces = c.split.findall(text)
    known = c.known
    counts = [known[p] if p in known else c.tokens(p) for p in pieces]
    starts, at = [], 0
    for k in range(0, len(pieces), LEAF):
        starts.append(at)
        at += sum(map(len, pieces[k : k + LEAF]))
    return starts, heap([sum(counts[k : k + LEAF]) for k in range(0, len(counts), LEAF)])


def edit(text: str, starts: list[int], nodes: list[int], start: int, stop: int, new: str, c: Counter) -> tuple[str, list[int], list[int], int]:
    """The edited text, its tree, and the characters that were encoded for it."""
    start = min(max(start, 0), len(text))
    stop = min(max(stop, start), len(text))
    out = text[:start] + new + text[stop:]
    shift = len(out) - len(text)
    # Encoding starts at the leaf before the one that holds the place before the edit.
    first = max(0, bisect_right(starts, start - 2) - 2)
    at = starts[first] if starts else 0
    later = max(bisect_left(starts, stop), first + 1)  # leaves from here on begin after the edit
    pieces, begins, last, end = [], [], len(starts), at
    for m in c.split.finditer(out, at):
        k = bisect_left(starts, m.start() - shift, later)
        if k < len(starts) and starts[k] + shift == m.start():
            last = k
            break
        pieces.append(c.tokens(m[0]))
        begins.append(m.start())
        end = m.end()
    leaves = last - first
    if leaves and leaves <= len(pieces) <= 2 * LEAF * leaves:
        # The pieces fill the leaves that were there, evenly: only the paths above them change.
        cuts = [k * len(pieces) // leaves for k in range(leaves + 1)]
        nodes = list(nodes)
        half = len(nodes) // 2
        touched = set()
        for k in range(leaves):
            nodes[half + first + k] = sum(pieces[cuts[k] : cuts[k + 1]])
            touched.add((half + first + k - 1) // 2)
        while touched and half:
            for k in touched:
                nodes[k] = nodes[2 * k + 1] + nodes[2 * k + 2]
            touched = {(k - 1) // 2 for k in touched if k > 0}
        fresh = [begins[k] for k in cuts[:-1]]
    else:
        counts = leaf_counts(starts, nodes)
        cuts = range(0, len(pieces), LEAF)
        fresh = [begins[k] for k in cuts]
        nodes = heap(counts[:first] + [sum(pieces[k : k + LEAF]) for k in cuts] + counts[last:])
    return out, starts[:first] + fresh + [s + shift for s in starts[last:]], nodes, end - at


#: Rows of a batch that are held as Python objects at a time.
ROWS = 256


def _slices(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    for k in range(0, max(1, len(columns[0])), ROWS):
        yield tuple(c.slice(k, ROWS) for c in columns)


def tree(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Struct column with the segment tree of each text."""
    kind = pa.struct([("starts", pa.list_(pa.int32())), ("nodes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(vocabulary)
        for texts in batches:
            parts = [pa.array([dict(zip(("starts", "nodes"), build(t or "", c), strict=True)) for t in some.to_pylist()], kind) for (some,) in _slices(texts)]
            yield pa.concat_arrays(parts)

    return F.arrow_udf(run, TREE)(text)


def edited(text: Column, tree: Column, edits: Column, vocabulary: str = VOCABULARY) -> Column:
    """Struct column with the text and tree after ``edits``, an array of (start, stop, new)."""
    kind = pa.struct([("text", pa.string()), ("starts", pa.list_(pa.int32())), ("nodes", pa.list_(pa.int64())), ("encoded", pa.int64())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        c = counter(vocabulary)
        for batch in batches:
            parts = []
            for texts, trees, lists in _slices(*batch):
                rows = []
                for t, held, changes in zip(texts.to_pylist(), trees.to_pylist(), lists.to_pylist(), strict=True):
                    t, starts, nodes, total = t or "", held["starts"], held["nodes"], 0
                    for e in changes or ():
                        if e is not None and e["start"] is not None:
                            t, starts, nodes, n = edit(t, starts, nodes, e["start"], e["stop"] if e["stop"] is not None else e["start"], e["new"] or "", c)
                            total += n
                    rows.append({"text": t, "starts": starts, "nodes": nodes, "encoded": total})
                parts.append(pa.array(rows, kind))
            yield pa.concat_arrays(parts)

    return F.arrow_udf(run, EDITED)(text, tree, edits)


def total(nodes: Column) -> Column:
    return F.coalesce(F.get(nodes, F.lit(0)), F.lit(0))


def sample_edits(text: Column) -> Column:
    """The edits of the query: a cut in the middle, a word in the first third, a new end."""
    n = F.length(text)
    one = lambda a, b, new: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), F.lit(new).alias("new"))
    return F.array(one(n / 2, n / 2 + 40, ""), one(n / 3, n / 3, " edited"), one(n, n, " The end."))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", tree(F.col("text")).alias("tree"))
    docs = docs.select("doc_id", "tree", edited(F.col("text"), F.col("tree"), sample_edits(F.col("text"))).alias("now"))
    return docs.select(
        "doc_id",
        total(F.col("tree.nodes")).alias("n_tokens"),
        F.size("tree.starts").cast("long").alias("n_leaves"),
        total(F.col("now.nodes")).alias("n_tokens_edited"),
        F.length("now.text").cast("long").alias("n_chars_edited"),
        F.col("now.encoded").alias("n_chars_encoded"),
    )

"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words and built into one suffix automaton. Training text is
streamed through it word by word; the automaton keeps the length of the longest item
passage that ends at each word. A passage of at least ``window`` words (or a whole item
that is shorter) is a hit.

Defined results: a null or wordless text has no words and no hits; an item without words
matches nothing; items with equal text are all listed; an item with a null id still marks
hits but is listed nowhere; repeated rows are reported once each. Columns of the input are
kept, and results come in one struct column whose name the caller picks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, table, tidy, written

WINDOW = 10
#: Words of items that one automaton may hold, about 60 MB; more items are scanned in blocks.
BLOCK_WORDS = 100_000
#: Share of words in hits from which a document is dropped rather than cut.
MAX_COVERAGE = 0.5

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

LEAK = "struct<n_words:bigint,spans:array<int>,items:array<string>,longest:int>"


def fold_words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text; A-Z lower-cased, split at every other ASCII sign."""
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over item words."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for name, ws in items if ws]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self._label(coded)

    def _clone(self, p: int, q: int, w: int) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:  # the passage is known from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return cur

    def _label(self, coded: list[tuple[str | None, list[int]]]) -> None:
        """Items of each window's state, and the short items that end in each state."""
        n, window = len(self.next), self.window
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.win = [0] * n
        for v in order:
            if self.length[v] >= window:
                self.win[v] = v if self.length[self.link[v]] < window else self.win[self.link[v]]
        self.items: dict[int, set[str]] = {}
        short: dict[int, set[str]] = {}
        for name, ws in coded:
            v = 0
            for i, w in enumerate(ws):
                v = self.next[v][w]
                if i + 1 >= window:
                    self.items.setdefault(self.win[v], set()).update(() if name is None else (name,))
            if len(ws) < window:
                short.setdefault(v, set()).update(() if name is None else (name,))
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        for v in order:
            found = list(self.short.get(self.link[v], ()))
            if v in short:
                found.append((self.length[v], short[v]))
            if found:
                self.short[v] = found
        self.least = min([window, *(len(ws) for _, ws in coded)])

    def scan(self, text: bytes) -> tuple[int, list[int], set[str], int]:
        """(words, hit spans as flat [start, end) word offsets, items, longest match)."""
        got = fold_words(text)
        n = len(got)
        if n < self.least or not self.ids:
            return n, [], set(), 0
        get = self.ids.get
        codes = np.fromiter((get(w, -1) for w in got), np.int32, n)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], codes >= 0, [0])).astype(np.int8)))
        hit: np.ndarray | None = None
        found: set[str] = set()
        longest = 0
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a < self.least:
                continue
            v = size = 0
            nxt, link, length, window = self.next, self.link, self.length, self.window
            for i, w in enumerate(codes[a:b].tolist(), a):
                while v and w not in nxt[v]:
                    v = link[v]
                    size = length[v]
                if w in nxt[v]:
                    v = nxt[v][w]
                    size += 1
                if size >= window:
                    span, who = window, self.items.get(self.win[v], ())
                    if hit is None:
                        hit = np.zeros(n, bool)
                    hit[i + 1 - span : i + 1] = True
                    found.update(who)
                    longest = max(longest, size)
                if v in self.short:
                    for m, who in self.short[v]:
                        if m <= size:
                            if hit is None:
                                hit = np.zeros(n, bool)
                            hit[i + 1 - m : i + 1] = True
                            found.update(who)
                            longest = max(longest, m)
        if hit is None:
            return n, [], set(), 0
        return n, np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])).astype(np.int8))).tolist(), found, longest


def merge_spans(*lists: list[int]) -> list[int]:
    """Union of flat span lists."""
    out: list[int] = []
    for a, b in sorted((s[i], s[i + 1]) for s in lists for i in range(0, len(s), 2)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _segments(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Items as word lists; a long item is cut into parts that overlap by window - 1 words."""
    step = BLOCK_WORDS // 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ws = fold_words(value or b"")
                for i in range(0, max(1, len(ws) - window + 1), step):
                    if part := ws[i : i + step + window - 1]:
                        rows.append((name, b" ".join(part).decode(), len(part)))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], ["item", "words", "n"])

    return items.select(F.col(item_id).cast("string"), text).mapInArrow(cut, "item string, words string, n bigint")


def _blocks(items: DataFrame, item_id: str, text: str, window: int) -> list[Automaton]:
    """Automata of at most BLOCK_WORDS words each; one is collected at a time."""
    parts = written(_segments(items, item_id, text, window).distinct(), "items")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = max(1, -(-total // BLOCK_WORDS))
    dealt = lambda k: parts.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(k)))
    while count > 1 and dealt(count).groupBy("block").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > BLOCK_WORDS:
        count *= 2
    for k in range(count):
        rows = dealt(count).filter(F.col("block") == k).orderBy("item", "words").collect()
        yield Automaton([(r.item, r.words.encode().split()) for r in rows], window)


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, out: str = "leak") -> DataFrame:
    """``docs`` with a struct column ``out``: words, hit word spans, items found, longest match.

    No shuffle of the documents: each block of items is broadcast (its words are bounded by
    BLOCK_WORDS) and the texts stream past it. A column of the name ``out`` is an error.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"documents have a column {out}")
    sc = docs.sparkSession.sparkContext
    done: DataFrame = docs
    for k, automaton in enumerate(_blocks(items, item_id, item_text, window)):
        held = sc.broadcast(automaton)
        before = F.lit(None).cast(LEAK) if k == 0 else F.col(f"`{out}`")
        if k:
            done = written(done, "leaks")
        done = done.withColumn(out, F.arrow_udf(_scanner(held), LEAK)(F.col(f"`{text}`"), before))
    return done


def _scanner(held):
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("longest", pa.int32())])

    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, before in batches:
            rows = []
            for value, old in zip(texts.cast(pa.binary()).to_pylist(), before.to_pylist(), strict=True):
                n, spans, found, longest = held.value.scan(value or b"")
                if old:
                    spans, found, longest = merge_spans(old["spans"], spans), found | set(old["items"]), max(longest, old["longest"])
                rows.append({"n_words": n, "spans": spans, "items": sorted(found), "longest": longest})
            yield pa.array(rows, kind)

    return scan


def span_words(spans) -> Column:
    """Words that flat spans cover."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def without_spans(text: str, spans: list[int]) -> str:
    """The text less the words of ``spans`` and what stands between them."""
    ends = [m.span() for m in _WORD.finditer(text)]
    keep, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        keep.append(text[at : ends[a][0]])
        at = ends[b - 1][1]
    return "".join([*keep, text[at:]])


def _cleaner(held, text: int, before: int | None, n_chars: int | None, columns: int, max_coverage: float):
    """Scan, decide and cut in one pass, so that a task has one Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text)
            keep, cut, fresh_texts = np.ones(len(texts), bool), np.zeros(len(texts), bool), []
            for k, value in enumerate(texts):
                value = value.as_py()
                n, spans, _, _ = held.value.scan((value or "").encode())
                old = batch.column(before)[k].as_py() if before is not None else None
                if old:
                    spans = merge_spans(old["spans"], spans)
                if spans:
                    keep[k] = sum(spans[1::2]) - sum(spans[::2]) <= n * max_coverage
                    cut[k] = True
                    fresh_texts.append(without_spans(value, spans) if keep[k] else "")
            cols = [batch.column(k) for k in range(columns)]
            if fresh_texts:
                cols[text] = pc.replace_with_mask(texts, pa.array(cut), pa.array(fresh_texts, texts.type))
                if n_chars is not None:
                    cols[n_chars] = pc.replace_with_mask(cols[n_chars], pa.array(cut), pa.array(map(len, fresh_texts), cols[n_chars].type))
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:columns]).filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", n_chars: str | None = "n_chars", max_coverage: float = MAX_COVERAGE, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Documents without benchmark passages, in their own columns.

    Hit spans are cut out of a text; a document with more than ``max_coverage`` of its
    words in hits is dropped. Documents without hits are returned as they are.
    """
    (out,) = fresh(docs, "_leak")
    names = docs.columns
    held = [docs.sparkSession.sparkContext.broadcast(a) for a in _blocks(items, item_id, item_text, window)]
    done = docs
    for k, automaton in enumerate(held[:-1]):
        before = F.lit(None).cast(LEAK) if k == 0 else F.col(f"`{out}`")
        done = written(done.withColumn(out, F.arrow_udf(_scanner(automaton), LEAK)(F.col(f"`{text}`"), before)), "leaks")
    at = names.index(n_chars) if n_chars in names else None
    return done.mapInArrow(tidy(_cleaner(held[-1], names.index(text), len(names) if len(held) > 1 else None, at, len(names), max_coverage)), docs.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    hits = span_words(F.col("leak.spans"))
    return found.select(
        "doc_id",
        F.col("leak.n_words").alias("n_words"),
        hits.alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(10, len(ws)) AS m, array_to_string(ws[p : p + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS p FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT m FROM iw),
dw AS (
  SELECT r, p, m, array_to_string(ws[p : p + m - 1], ' ') AS win
  FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM w, sizes WHERE len(ws) >= m)),
hit AS (SELECT r, p, iw.m, item FROM dw JOIN iw ON dw.win = iw.win AND dw.m = iw.m),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM hit) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""

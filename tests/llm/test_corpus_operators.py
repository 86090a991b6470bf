"""Operators over the whole corpus: line dedup, sharding, WARC, n-gram join, mixing, pipeline."""

import base64
import gzip
import hashlib
import math
import os
import random
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cantera.llm import line_dedup, linking, mixing, ngram_join, sharding, warc
from cantera.llm import queries as registry
from cantera.llm.components import components
from cantera.llm.shared import scratch

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def words(rnd, n, letters="abcdefghijklmnopqrstuvwxyz"):
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n)]


def edited(rnd, ws, share):
    return [w if rnd.random() > share else rnd.choice(words(rnd, 1)) for w in ws]


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    w = [x for x in w if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(rows):
    """Smallest id of each row's component, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(x)] = root(y)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[root(k)].append(i)
    return [(i, len(s), min(x for x in least[root(k)] if x is not None) if s and any(x is not None for x in least[root(k)]) else i) for k, (i, s) in enumerate(sets)]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    passage = words(rnd, 40)
    rows = []
    for n in (3, 4, 5, 6, 8, 12, 30, 80, 200):
        for _ in range(3):
            base = words(rnd, n)
            rows += [" ".join(base)] + [" ".join(edited(rnd, base, share)) for share in (0.01, 0.03, 0.05, 0.1)]
            rows += [" ".join(base[: max(1, int(n * 0.85))]), " ".join(base + passage), "  ".join(base).upper() + "\n"]
    rows = list(enumerate(rows)) + [(900, None), (901, ""), (902, " \t\n"), (None, rows[0]), (903, "one"), (904, "ONE"), (3, rows[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(map(tuple, ngram_join.similar_groups(docs).collect()))
    assert got == Counter(groups(rows))


def test_ngram_join_hot_group(spark):
    """Near copies by the hundred, and a passage that makes up much of many texts."""
    rnd = random.Random(9)
    base, passage = words(rnd, 60), words(rnd, 50)
    rows = [" ".join(edited(rnd, base, 0.02)) for _ in range(150)] + [" ".join(words(rnd, rnd.randint(5, 40)) + passage) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    assert Counter(map(tuple, ngram_join.similar_groups(docs).collect())) == Counter(groups(list(enumerate(rows))))


def test_keep_one(spark):
    rnd = random.Random(2)
    base = words(rnd, 60)
    rows = [(5, " ".join(base), "k"), (3, " ".join(base[:58]), "k"), (3, " ".join(base[:58]), "k"), (9, "other text here", "k"), (1, None, "k"), (2, "", "k")]
    rows += [(None, " ".join(base), "k"), (None, "a text without an id", "k"), (None, "a text without an id", "k")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _th string")
    got = ngram_join.keep_one(docs)
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == ["1", "2", "3", "9", "None"] and got.columns == docs.columns
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


def test_pigeonhole_bounds():
    most, segments = ngram_join.levels()
    for n in range(1, 400):
        js, upper = ngram_join.bands(n, 75, most)
        for m in range(math.ceil(0.75 * n), n * 4 // 3 + 1):
            h = ngram_join.differences(n + m, 75)
            if h:  # sets that differ meet at a level that serves their difference
                j = next(k for k in range(len(most)) if most[k] >= h)
                assert j in js and h <= upper and segments[j] > most[j]
                assert j in ngram_join.bands(m, 75, most)[0]


def test_neighbourhoods_meet():
    """Sets with few enough differences share a signature of a level that indexes neighbourhoods."""
    rnd = random.Random(3)
    most, _ = ngram_join.levels()
    for _ in range(2000):
        j = rnd.randint(1, 6)
        common = {rnd.getrandbits(64) for _ in range(rnd.randint(1, 30))}
        extra = [rnd.getrandbits(64) for _ in range(rnd.randint(0, int(most[j])))]
        cut = rnd.randint(0, len(extra))
        a, b = (np.array(sorted(common | set(x)), np.uint64) for x in (extra[:cut], extra[cut:]))
        m = ngram_join.segments_near(int(most[j]))
        assert set(ngram_join.neighbourhood(a, j, m).tolist()) & set(ngram_join.neighbourhood(b, j, m).tolist())


def test_allocation_picks_either_way():
    most, segments = ngram_join.levels()
    # Level 1 has many sets with empty subsets either way but more of them plain, level 2 none, level 3 few sets.
    sums = {1: [40_000, 30_000, 70_000, 50], 2: [50_000, 0, 90_000, 0], 3: [40, 3, 60, 0]}
    assert ngram_join.allocation(sums, most, segments) == {1}
    rnd = random.Random(4)
    for j in range(1, 8):
        need = int(most[j]) + 1
        for n in (1, 3, 9, 30):
            s = np.array(sorted({rnd.getrandbits(64) for _ in range(n)}), np.uint64)
            plain, empty, deep, deep_empty = ngram_join.costs(s, int(most[j]), int(segments[j]), need)
            assert plain == len(ngram_join.signatures(s, j, int(segments[j]), need)) and 0 <= empty <= plain
            assert deep >= len(ngram_join.neighbourhood(s, j, ngram_join.segments_near(int(most[j])))) and 0 <= deep_empty <= deep


def test_ngram_join_with_neighbourhoods(spark, monkeypatch):
    """The same groups when pairs are so dear that short levels index neighbourhoods, and when cells are split into blocks."""
    rnd = random.Random(6)
    base = [words(rnd, n) for n in (3, 5, 6, 7, 9, 12, 20, 40)]
    rows = [" ".join(w) for w in base] + [" ".join(edited(rnd, w, share)) for w in base for share in (0.03, 0.06, 0.1) for _ in range(3)] + [" ".join(words(rnd, rnd.randint(5, 9))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    chosen = []
    real = ngram_join.allocation
    monkeypatch.setattr(ngram_join, "PAIR_COST", 1000.0)
    monkeypatch.setattr(ngram_join, "allocation", lambda *a: chosen.append(real(*a)) or chosen[-1])
    monkeypatch.setattr(linking, "BLOCK", 3)
    assert Counter(map(tuple, ngram_join.similar_groups(docs).collect())) == Counter(groups(list(enumerate(rows))))
    assert chosen[0]


def test_shared_sigs(spark):
    rnd = random.Random(0)
    rows = [(rnd.randint(0, 40), rnd.randint(0, 5)) for _ in range(200)]
    got = sorted(map(tuple, linking.shared_sigs(spark.createDataFrame(rows, "sig bigint, key bigint")).collect()))
    keys = defaultdict(set)
    for s, k in rows:
        keys[s].add(k)
    assert got == sorted((s, k) for s, ks in keys.items() if len(ks) > 1 for k in ks)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 260)] + [(500, 500)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def lines_to_drop(rows):
    """Line numbers that go, per (doc_id, text), by comparing all pairs of lines."""
    occ = []
    for i, t in rows:
        for k, line in enumerate((t or "").encode().split(b"\n")):
            norm = line_dedup.normalise(line)
            if norm.count(b" ") + 1 >= line_dedup.MIN_WORDS:
                occ.append((i, t, k, norm))
    norms = sorted({o[3] for o in occ})
    sims = dict(zip(norms, line_dedup.simhashes(norms).tolist(), strict=True)) if norms else {}
    parent = {n: n for n in norms}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    for i, x in enumerate(norms):
        for y in norms[:i]:
            a, b = x.decode(), y.decode()
            if (sims[x] ^ sims[y]).bit_count() <= 3 and distance(a, b) <= max(len(a), len(b)) * 20 // 100 and min(len(x), len(y)) * 100 >= max(len(x), len(y)) * 80:
                parent[root(x)] = root(y)
    return occ, root


def test_line_dedup_matches_brute_force(spark):
    rnd = random.Random(8)
    base = [words(rnd, n) for n in (3, 10, 60, 60, 120, 200)]
    pool = [" ".join(w) for w in base] + [" ".join(edited(rnd, w, 0.02)) for w in base for _ in range(4)] + [" ".join(w).upper() + "!" for w in base] + ["ok", "", "two words"]
    rows = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 6)))) for k in range(25)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    occ, root = lines_to_drop(rows)
    kept = line_dedup.line_groups(docs).collect()
    assert len(kept) == len(occ)
    norm = {(i, k): n for i, _, k, n in occ}
    count = Counter(root(norm[r.id, r.place]) for r in kept if r.keep)
    assert set(count.values()) == {1} and set(count) == {root(n) for n in norm.values()}
    first = {}
    for i, _, k, n in occ:
        first[root(n)] = min(first.get(root(n), (i, k)), (i, k))
    assert {(r.id, r.place) for r in kept if r.keep} == set(first.values())
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    for i, t in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in norm or (i, k) in first.values())
        assert out[i] == want


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def alike(a, b):
    return edit_distance(a, b) <= max(len(a), len(b)) * 20 // 100


def test_edit_distance_within_a_bound():
    rnd = random.Random(7)
    for _ in range(3000):
        x = "".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 40)))
        y = list(x)
        for _ in range(rnd.randint(0, 8)):
            k = rnd.randint(0, len(y))
            y[k : k + rnd.randint(0, 2)] = rnd.choice(["", "a", "zz"])
        y = "".join(y)
        d = edit_distance(x, y)
        for most in (0, d - 1, d, d + 1, 5):
            assert line_dedup.within(x, y, most) == (d <= most), (x, y, most)


def test_edit_distance_of_many_pairs_at_once():
    """As one by one: of no, one and many words of bits, of equal and far lengths, of scripts with many signs."""
    rnd = random.Random(17)
    xs, ys, most = [], [], []
    for k in range(3000):
        n = rnd.choice((0, 5, 63, 64, 65, 130, 300))
        signs = "abé " if k % 3 else [chr(0x4E00 + i) for i in range(400)]
        x = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, n)))
        y = list(x)
        for _ in range(rnd.randint(0, n // 4 + 1)):
            at = rnd.randint(0, len(y))
            y[at : at + rnd.randint(0, 2)] = rnd.choice(["", "a", "zz"])
        xs.append(x)
        ys.append("".join(y) if k % 10 else "".join(rnd.choice(signs) for _ in range(rnd.randint(0, n))))
        most.append(rnd.choice((max(len(x), len(y)) // 5, rnd.randint(0, n // 4 + 2))))
    got = line_dedup.within_each(xs, ys, np.array(most))
    assert got.tolist() == list(map(line_dedup.within, xs, ys, most)) and 500 < got.sum() < 2500
    assert line_dedup.within_each([], [], np.zeros(0, int)).tolist() == []


@pytest.mark.parametrize("met", (3, 1000))
def test_keys_that_meet_nothing_close_go_no_further(met, monkeypatch):
    """Of the rows of a sig only those with a close one go on; of sigs beyond the limit all do, once, however batches fall."""
    monkeypatch.setattr(line_dedup, "MET", met)
    rnd = random.Random(met)
    near = {k: (rnd.randint(30, 60), rnd.choice((0, 1, 3, (1 << 60) - 1, 0xFFFFFFFF))) for k in range(1, 60)}
    rows = sorted((sig, near[k][0], k) for sig in range(40) for k in rnd.sample(range(1, 60), rnd.choice((1, 2, 3, 8, 20))) for _ in range(rnd.randint(1, 2)))
    table = pa.table({"sig": pa.array([r[0] for r in rows], pa.int64()), "key": pa.array([r[2] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()), "sketch": pa.array([near[r[2]][1].to_bytes(8, "little") for r in rows], pa.binary())})

    def close(a, b):
        (n, s), (m, t) = near[a], near[b]
        return min(n, m) * 100 >= max(n, m) * 80 and (s ^ t).bit_count() <= 3

    whole = {sig: sorted({r[2] for r in rows if r[0] == sig}) for sig in range(40)}
    met_keys = {sig: tuple(k for k in keys if any(close(k, x) for x in keys if x != k)) for sig, keys in whole.items()}
    for size in (1, 7, 5000):
        got = defaultdict(list)
        for batch in line_dedup._meeting(lambda na, nb, sa, sb: np.bitwise_count(sa ^ sb).sum(1) <= 3)(iter(table.to_batches(max_chunksize=size))):
            for r in batch.to_pylist():
                got[r["sig"], r["g"]].append(r["key"])
                assert r["other"] is None or close(r["key"], r["other"])
                assert r["g"] is None or r["other"] is not None
        large = {sig for sig, g in got if g is None}
        assert bool(large) == (met == 3)
        assert all(sorted(got.pop((sig, None))) == whole[sig] and len(whole[sig]) > met for sig in large)
        # Sigs of equal keys have one name.
        want = Counter(keys for sig, keys in met_keys.items() if sig not in large and keys)
        assert {tuple(sorted(set(v))): len(v) for v in got.values()} == {keys: len(keys) * n for keys, n in want.items()}
        assert all(len(set(v)) == g for (_, g), v in got.items())


def test_short_lines_that_link_share_a_key():
    rnd = random.Random(2)
    for _ in range(4000):
        x = "".join(rnd.choice("ab cdé") for _ in range(rnd.randint(4, line_dedup.SHORT)))
        y = list(x)
        for _ in range(rnd.randint(1, 4)):
            k = rnd.randrange(len(y))
            y[k : k + rnd.randint(0, 1)] = rnd.choice(["", "a", "b"])
            y = y or ["a"]
        y = "".join(y)
        if x != y and len(y) <= line_dedup.SHORT and alike(x, y):
            assert line_dedup.short_keys(x) & line_dedup.short_keys(y), (x, y)
            assert line_dedup.may_link(x, y), (x, y)


def test_line_dedup_links_by_edit_similarity_alone(spark):
    """No bound on bits and no least number of words: a changed word in a short line, one-word lines, lines without spaces."""
    rnd = random.Random(12)
    base = [" ".join(words(rnd, n)) for n in (1, 2, 2, 4, 5, 8, 10, 12, 15, 20, 20, 30)] + ["ok", "価格は予告なく変更されることがあります", "お問い合わせはこちら"]
    pool = list(base)
    for line in base:
        w = line.split(" ")
        for k in rnd.sample(range(len(w)), min(3, len(w))):
            pool.append(" ".join([*w[:k], *w[k + 1 :]]))
            pool.append(" ".join([*w[:k], rnd.choice(words(rnd, 1)), *w[k + 1 :]]))
            pool.append(" ".join([*w[:k], w[k][1:] + "x", *w[k + 1 :]]))
    pool += ["価格は予告なく変更される場合があります", "お問合わせはこちら", "---", ""]
    rows = [(k, "\n".join(rnd.sample(pool, 8))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    norm = {(i, k): line_dedup.normalise(x.encode()).decode() for i, t in rows for k, x in enumerate(t.split("\n"))}
    norm = {at: x for at, x in norm.items() if x}
    parent = {x: x for x in norm.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in parent:
        for y in parent:
            if x < y and alike(x, y):
                parent[root(x)] = root(y)
    first = {}
    for at in sorted(norm):
        first.setdefault(root(norm[at]), at)
    got = line_dedup.line_groups(docs, min_words=1, max_bits=None).collect()
    assert {(r.id, r.place) for r in got} == set(norm)
    assert {(r.id, r.place) for r in got if r.keep} == set(first.values())
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, min_words=1, max_bits=None).collect()}
    for i, t in rows:
        assert out[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in norm or (i, k) in first.values())


@needs_data
def test_lines_of_one_passage_are_compared_without_a_row_for_each_pair(spark, monkeypatch):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(3, 7)))
    passage = " ".join(word() for _ in range(14))
    lines = [" ".join([*(word() for _ in range(4)), passage, *(word() for _ in range(4))]) for _ in range(60)]
    lines += [x[:-1] + "z" for x in lines[:5]]
    counts = {}

    def counted(df, label):
        out = written(df, label)
        counts[label] = max(counts.get(label, 0), out.count())
        return out

    written = linking.written
    for module in (line_dedup, linking):
        monkeypatch.setattr(module, "written", counted)
    monkeypatch.setattr(linking, "BLOCK", 16)
    got = {r.id: r.keep for r in line_dedup.line_groups(spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string"), min_words=1, max_bits=None).collect()}
    assert got == {k: k < 60 for k in range(65)} and not any(line_dedup.links(x, y) for x, y in combinations(lines[:60], 2))
    assert max(v for k, v in counts.items() if k not in ("shared", "groups", "members", "rooted")) <= 2 * 65, counts


def test_line_dedup_query_drops_short_repeats(spark):
    """Every repeat of a line with text goes, of one and two words too."""
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: {int(k) for k in r.dropped.split(",") if k} for r in registry.QUERIES["op3_line_dedup"](spark, SF).collect()}
    kept = Counter(x for i, t in rows.items() for k, line in enumerate((t or "").encode().split(b"\n")) if k not in got[i] and (x := line_dedup.normalise(line)))
    assert max(kept.values()) == 1


def test_line_dedup_empty(spark):
    docs = spark.createDataFrame([], "doc_id int, text string, key string")
    assert line_dedup.dedup_lines(docs).columns == docs.columns and line_dedup.dedup_lines(docs).count() == 0


def test_sharding(spark):
    root = scratch(spark, "shards")
    docs = spark.range(4000).select("id", F.repeat(F.md5(F.col("id").cast("string")), 3).alias("path"), F.lit(None).cast("string").alias("tier"))
    assert sharding.append(docs.repartition(3), root, arrival_rows=100) == 1
    assert sharding.append(spark.createDataFrame([(7, "x", "y"), (7, "x", "y")], "id bigint, path string, tier string"), root) == 2
    before = sharding.manifest(spark, root)
    small = before.count()
    size = before.agg(F.sum("bytes")).first()[0]
    assert sharding.compact(spark, root, target_bytes=size // 4) == 3
    after = sharding.manifest(spark, root)
    assert 2 < after.count() < small / 3 and after.agg(F.sum("rows")).first()[0] == 4002
    every = lambda df: Counter(map(tuple, df.collect()))
    assert every(sharding.read(spark, root)) == every(sharding.read(spark, root, 2)) and sharding.read(spark, root, 1).count() == 4000
    with pytest.raises(sharding.Conflict):
        sharding.commit(spark, root, after, 3)
    assert sharding.versions(spark, root) == [1, 2, 3]
    assert sharding.vacuum(spark, root) > 0 and sharding.versions(spark, root) == [3]
    assert sharding.read(spark, root).count() == 4002


def test_sharding_empty(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    got = sharding.shard(docs)
    assert got.count() == 0 and got.columns == docs.columns


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>"), (5, "http://b/", "<p>é</p>"), (3, None, ""), (4, "http://c/", None), (None, "http://d/", "<p>é</p>"), (6, "http://e/%41", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = scratch(spark, "warc")
    warc.write_archives(pages, path)
    got = {r.page: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == 6
    assert {k: r.record_type for k, r in got.items()} == {"1": "revisit", "5": "response", "3": "revisit", "4": "response", None: "revisit", "6": "response"}
    assert (got["1"].refers_to, got["3"].refers_to, got["1"].payload) == ("5", "4", None)
    assert bytes(got["5"].payload).decode() == "<p>é</p>" and bytes(got["4"].payload) == b"" and bytes(got["6"].payload) == b"WARC/1.1\r\n\r\n"
    assert got["1"].uri == "http://a/\r\nX: y" and got["6"].uri == "http://e/%41" and got["3"].uri is None
    assert got["1"].digest == base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode() and got["1"].payload_bytes == 9
    only = warc.read_archives(spark, path).filter("record_type = 'response' and page in ('5', '6')")
    assert sorted(r.page for r in only.collect()) == ["5", "6"]
    assert all(r.payload is None for r in warc.read_archives(spark, path, payload=False).collect())
    warc.write_archives(pages.limit(1), path)
    assert warc.read_archives(spark, path).count() == 7


def test_warc_pushdown_and_empty(spark):
    reader = warc.WarcReader("file:///nowhere", True)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert reader.equal == [("record_type", {"revisit"})] and rest == [GreaterThan(("payload_bytes",), 3)]
    path = scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_warc_of_other_writers(spark, tmp_path):
    def record(headers, block):
        return "\r\n".join(["WARC/1.0", *headers, f"content-length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    data = [
        record(["warc-type: warcinfo"], b"software: x\r\n"),
        record(["WARC-TYPE: response", "warc-target-uri:  http://x/a%20b "], b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"),
        record(["WARC-Type: response", "WARC-Target-URI: dns:x"], b"no head"),
        record(["WARC-Type: request"], b"GET / HTTP/1.1\r\n\r\n"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    rows = warc.read_archives(spark, f"file://{tmp_path}").select("record_type", "uri", "digest", "payload").collect()
    want = [("request", None, None, None), ("response", "dns:x", None, b"no head"), ("response", "http://x/a%20b", None, b"body"), ("warcinfo", None, None, None)]
    assert sorted(((r.record_type, r.uri, r.digest, r.payload and bytes(r.payload)) for r in rows), key=str) == sorted(want * 2, key=str)
    pages = spark.createDataFrame([(1, " http://x/%41 ", "t"), (2, None, None)], "page_id bigint, url string, html string")
    path = scratch(spark, "warc")
    warc.write_archives(pages, path)
    assert {r.page: r.uri for r in warc.read_archives(spark, path).collect()} == {"1": " http://x/%41 ", "2": None}


def test_mixing(spark):
    rnd = random.Random(4)
    rows = [(k, " ".join(["w"] * rnd.choice([0, 1, 20, 300])), rnd.choice(["a", "a", "a", "b", "c", None])) for k in range(400)] + [(400, None, "z"), (None, "x y", "b"), (3, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    by_id = {r[0]: r for r in rows}
    for r in got:
        s = by_id[r.doc_id][2] if r.doc_id not in (None, 3) else None
        assert 0 <= r.taken <= 2 * r.size
        if s is not None:
            sizes[s] += r.size
            target[s] = r.target
            taken[s] += r.taken
    total = sum(len((t or "").split()) for _, t, _ in rows)
    assert abs(sum({(r.source_size, r.target) for r in got} and {r.source_size: r.target for r in got}.values()) - 1.5 * total) < 0.01 * total + 5
    for s in ("a", "c"):
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 320
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_meets_every_target(spark):
    """Small sources and the null one too, beside one that makes the blocks of a shared schedule large."""
    sizes = {"a": [1000] * 400, "b": [20], "c": [7, 13], "d": [50, 0, 100], "e": [1], "f": [250] * 4, None: [3, 5]}
    rows = [(f"{s}-{k}", " ".join(["w"] * n), s) for s, ns in sizes.items() for k, n in enumerate(ns)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id string, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        s = r.doc_id.split("-")[0]
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert len(target) == len(sizes) and len(got) == len(rows)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target), (taken, target)


def test_schedule_follows_the_weights(spark):
    """Any prefix of the slots gives each source its share; the slots of a source take its blocks in turn, equal to a word."""
    rows = [(k, " ".join(["w"] * (1 + k % 7)), "abc"[k % 3], -k) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, slot int")
    drawn = mixing.schedule(docs).collect()
    target = {r["source"]: r["target"] for r in mixing.pieces(docs)[0].select("source", "target").distinct().collect()}
    total, by_slot, of = sum(target.values()), Counter(), {}
    for r in drawn:
        by_slot[r.slot] += r.words
        of[r.slot] = r.source
    for s in target:
        sizes = {n for k, n in by_slot.items() if of[k] == s}
        assert max(sizes) - min(sizes) <= 1
    for part in (0.1, 0.25, 0.5, 0.9):
        head = [k for k in sorted(by_slot)][: int(part * len(by_slot))]
        given = Counter()
        for k in head:
            given[of[k]] += by_slot[k]
        for s in target:
            assert abs(given[s] / sum(given.values()) - target[s] / total) < 0.01


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(found.fetchall())


@needs_data
def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and names[1] == "ngram_jaccard_join"
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        before = seen.collect()
        if name == "ngram_jaccard_join":
            want = {c for _, n, c in groups([(r.doc_id, r.text) for r in before])}
            assert {r.doc_id for r in rows} == want
        if name == "sharding":
            assert Counter(map(tuple, rows)) == Counter(map(tuple, before))
        if name == "source_mixing":
            assert max(Counter(r.doc_id for r in rows).values()) <= 2
        assert {r.doc_id for r in rows} <= set(texts)
        seen = spark.createDataFrame(rows, docs.schema)

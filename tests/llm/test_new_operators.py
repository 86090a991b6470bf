"""Source divergence, conversation repair and packing against brute force and their SQL, and odd inputs."""

import hashlib
import heapq
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cantera.llm import conversations, decontaminate, divergence, packing, sharding
from cantera.llm import queries as registry

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", ["op11_divergence", "op12_conversation_repair"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = registry.QUERIES[name](spark, SF)
    found = con.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(found.fetchall())


# ---- divergence


def divergence_by_hand(rows, k, min_docs):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t in df if df[t] >= min_docs]
        counts = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if df[t] >= min_docs) for s in {d[1] for d in docs if d[0] == lang}}
        whole = sum(counts.values(), Counter())

        def p(c):
            total = sum(c.values())
            return lambda t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        q = p(whole)
        for s in counts:
            mine = p(counts[s])
            pairs = [(sum(f(mine(t), p(counts[o])(t)) for t in kept), o) for o in counts if o != s]
            terms = [(f(mine(t), q(t)), t) for t in kept if counts[s][t] and mine(t) > q(t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, k)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, r + 1) for r, (v, item) in enumerate(found[:most])}
    return out


def test_divergence_matches_brute_force(spark, monkeypatch):
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choice("abÉñ東") for _ in range(rnd.randint(1, 4))) for _ in range(150)]
    rows = [(" ".join(rnd.choice(vocabulary[: rnd.choice([3, 20, 150])]).upper() for _ in range(rnd.randint(0, 60))), rnd.choice(["x", "x", "y", None]), rnd.choice(["s1", "s1", "s1", "s2", "é", None, "S"])) for _ in range(300)]
    rows += [(None, "x", "only null"), ("", "z", "no term"), ("one two one", "z", "t"), (rows[0][0], rows[0][1], rows[0][2])] * 2
    rows.append(("wörd, " * 400_000, "x", "long"))
    docs = spark.createDataFrame([(k, *r, "clash") for k, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, term string").repartition(3)
    monkeypatch.setattr(divergence, "HELD", 50)
    for k, least in ((10, 5), (3, 1)):
        got = [tuple(r) for r in divergence.audit(docs, k, least).collect()]
        assert len(got) == len(set(got))
        assert set(got) == divergence_by_hand(rows, k, least)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_divergence_ties_at_the_kth_place(spark):
    """Many terms with one value: the least in UTF-8 order come in, from whatever bucket."""
    rows = [(" ".join(f"t{chr(97 + k)}" for k in range(26)), "x", "a")] * 3 + [("other " * 50, "x", "b")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = {tuple(r) for r in divergence.audit(docs, 10, 1).collect()}
    assert got == divergence_by_hand(rows, 10, 1)


@given(st.integers(0, 1 << 52), st.integers(1, 1 << 52))
@settings(max_examples=200)
def test_slices_and_buckets(n, whole):
    n = min(n, whole)
    rest, out = n + 2, 0
    for _ in range(3):  # the long division of ``probability``
        rest *= 1000
        assert rest < 1 << 63
        out, rest = out * 1000 + rest // whole, rest % whole
    assert out == 10**9 * (n + 2) // whole


def test_terms_of_slices(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 7)
    text = "Ab cdefghijklmnop é東 x1y " * 5
    assert [t for s in divergence.slices(text.encode()) for t in s] == re.findall(rb"[a-z\x80-\xff]+", text.lower().encode())


# ---- conversations

RULE = re.compile(r"(s?(ua)+)?")


def cheapest(signature):
    """Cost and least cheapest script, by searching scripts in order of (cost, script)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, script, i, roles = heapq.heappop(heap)
        if i == len(signature) and RULE.fullmatch(roles):
            return cost, script
        state = (i, roles[-1:])  # the rest depends on nothing else
        if state in seen or roles and not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        seen.add(state)
        for r in "ua":
            heapq.heappush(heap, (cost + 5, script + "I", i, roles + r))
        if i < len(signature):
            letter = signature[i]
            heapq.heappush(heap, (cost + 2, script + "D", i + 1, roles))
            if letter != "x":
                extra = 5 * letter.isupper()
                heapq.heappush(heap, (cost + extra, script + "K", i + 1, roles + letter.lower()))
                for r in "ua":
                    heapq.heappush(heap, (cost + 1 + extra, script + "R", i + 1, roles + r))


@given(st.lists(st.text("xsuaoSUAO", max_size=9), max_size=20, unique=True))
@settings(max_examples=150, deadline=None)
def test_scripts_match_search(signatures):
    signatures.sort()
    assert [(s, c, a) for s, c, a in conversations.solved(iter(signatures))] == [(s, *cheapest(s)) for s in signatures]


def test_layers_are_shared(monkeypatch):
    made = []
    layer = conversations._layer
    monkeypatch.setattr(conversations, "_layer", lambda before, letter: made.append(letter) or layer(before, letter))
    list(conversations.solved(iter(["uauaua", "uauauaS", "uauauaU", "uauauax"])))
    assert len(made) == 9  # six of the shared prefix, one for each branch


def repair_by_hand(rows):
    """rows: (conv_id, turn, role, text) -> contract row by conversation, over whole lists."""
    damaged = defaultdict(list)
    blank = " \t\n\x0b\f\r"
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        damaged.setdefault(conv, [])
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            damaged[conv] += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = {}
    for conv, turns in damaged.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            faults.append("blank" if not text.strip(blank) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(blank)[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in turns]
        known = [t[0] for t in turns if t[0] is not None]
        letters = "".join("x" if f in ("blank", "duplicate") else (i if i and i in "sua" else "o").upper() if f else i if i and i in "sua" else "o" for f, i in zip(faults, initials))
        cost, script = cheapest(letters)
        made, at = [], 0
        for e in script:
            role, text = (turns[at][1], turns[at][2]) if e != "I" else ("", "")
            at += e != "I"
            if e in "IR":
                role = "assistant" if made and made[-1].startswith("u") else "user"
            if e != "D":
                made.append(f"{role}:{text}")
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, script, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def test_repair_matches_brute_force(spark):
    rnd = random.Random(5)
    texts = ["Hello there.", "What?\n", "no end", "", " \t", None, "a.b", "x" * 50 + "!", "é…", "Hello there. "]
    rows = [(rnd.choice([None, 1, 2, 3, *range(10, 60)]), rnd.choice([None, 0, 1, 2, 3, 4, 5, 9, 400]), rnd.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "U"]), rnd.choice(texts)) for _ in range(500)]
    rows += [(900, 7, "user", "only one."), (901, 0, "user", None)] + [(902, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(3000)] + rows[:20]
    rows.append((903, 1, "user", "long " * 400_000 + "end."))
    df = spark.createDataFrame([(*r, "other", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, kind string, edit int").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair_report(df, conversations.damaged(df)).collect()}
    assert got == repair_by_hand(rows)
    assert conversations.repair_report(df.limit(0), conversations.damaged(df.limit(0))).collect() == []


def test_conversation_that_loses_all_rows(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")
    (row,) = conversations.repair_report(df, conversations.damaged(df)).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_repaired_turns(spark):
    df = spark.createDataFrame([("c", 0, "assistant", "Yes."), ("c", 1, "user", "Why?"), ("c", 2, "assistant", "So."), ("c", 3, "user", "Bye.")], "conv_id string, turn int, role string, text string")
    audits = conversations.audited(df)
    assert [tuple(r) for r in audits.select("cost", "audit").collect()] == [(4, "DKKD")]
    assert [tuple(r) for r in conversations.repaired(df, audits).collect()] == [("c", "user", "Why?", "K"), ("c", "assistant", "So.", "K")]


# ---- packing


def laid_out(rows, histogram, capacity):
    """Check that runs place every piece once, without gaps or overlaps; the number of sequences."""
    bins, rows = defaultdict(list), sorted(rows)
    for k, (s, rank, first, each, offset) in enumerate(rows):
        stop = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == s else histogram[s]
        assert rank < stop and (rank == 0 or rows[k - 1][0] == s)
        for j in range(stop - rank):
            bins[first + j // each].append((offset + j % each * s, s))
    for some in bins.values():
        at = 0
        for offset, s in sorted(some):
            assert offset == at
            at += s
        assert at <= capacity
    assert Counter(s for some in bins.values() for _, s in some) == Counter(histogram)
    return len(bins)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=40), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_plans_are_packings(histogram, groups):
    rows, made = packing.plan(histogram, 64, groups)
    assert laid_out(rows, histogram, 64) <= made


def test_few_sequences():
    """Within a percent of the lower bound over even and over small lengths, and exact where pairs must match."""
    rnd = random.Random(2)
    for lengths in ([rnd.randint(1, 2047) for _ in range(40_000)], [min(2048, int(rnd.lognormvariate(6.3, 1.1)) + 1) for _ in range(40_000)], [rnd.randint(1, 300) for _ in range(20_000)]):
        h = Counter(lengths)
        rows, _ = packing.plan(h)
        assert laid_out(rows, h, 2048) <= 1.01 * sum(lengths) / 2048 + 1
    h = {1200: 500, 848: 500, 1500: 300, 548: 300, 2048: 7}
    assert laid_out(packing.plan(h)[0], h, 2048) == 807


def test_ids_are_those_of_the_tokenizer():
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    tokenizer.encode_special_tokens = True
    e = packing.Encoder(packing.TOKENIZER)
    rnd = random.Random(4)
    texts = ["", " ", "don't  stop\n\n  x", "a\x1cb \x85 c d", "東京 is　big ١٢٣ ² ½", "<|endoftext|> end", "ﬁ ſ ß ŉ \xad ª", "\x00\x07 tab\t\t x"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x250), 32, 10, rnd.randrange(0x250, 0x3000)])) for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert e.encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    long = " ".join(rnd.choice(["word", "it's", "12", "Élan", "…"]) for _ in range(400_000))
    assert e.encode(long) == np.array(tokenizer.encode(long, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_matches_brute_force(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("alpha beta gamma delta epsilon zeta 12 don't".split()) for _ in range(rnd.choice([0, 1, 5, 60, 300, 900, 3000]))) for _ in range(250)]
    rows = [(k % 240, t) for k, t in enumerate(texts)] + [(None, "no id"), (500, None), (501, ""), (502, "x" * 300_000), (0, texts[0])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, piece int, length int").repartition(4)
    got = packing.packed(docs).collect()
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    want = Counter()
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for some in bins.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.03 * sum(r.length for r in got) / 2048 + 1
    assert packing.packed(docs.limit(0)).collect() == []


# ---- earlier operators


def test_leaks_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "mine")], "doc_id int, text string, Leak string")
    items = spark.createDataFrame([(1, "a b")], "item_id int, text string")
    with pytest.raises(ValueError, match="leak"):
        decontaminate.find_leaks(docs, items)
    (row,) = decontaminate.find_leaks(docs, items, out="found").collect()
    assert (row.Leak, row.found.spans) == ("mine", [0, 2])


def test_vacuum_takes_data_of_dead_writers(spark, tmp_path):
    root = f"file://{tmp_path}/shards"
    df = spark.createDataFrame([(k, "x") for k in range(20)], "id int, t string")
    sharding.append(df, root)
    df.coalesce(1).write.parquet(f"{root}/data/dead")
    assert sharding.vacuum(spark, root) == 0 and (tmp_path / "shards/data/dead").exists()
    assert sharding.vacuum(spark, root, -1) == 1 and not (tmp_path / "shards/data/dead").exists()
    assert sorted(r.id for r in sharding.read(spark, root).collect()) == list(range(20))

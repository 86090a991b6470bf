"""Claims and facts: bindings against brute force, with ties, scopes and nulls."""

import random
import re
import unicodedata

from cantera.operators import bindings


def fold(text):
    bare = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not 0x300 <= ord(c) <= 0x36F)
    return re.sub(r"\bdiari[oa]s?\b", "dias", re.sub("[^a-z0-9]+", " ", bare.lower()).strip())


def matches(text, fact):
    t, f = fold(text), fold(fact)
    tokens = [w for w in t.split() if len(w) >= 3 or w.isdigit()]
    return any(w in f for w in tokens) or any(len(w) >= 4 and w in t for w in f.split())


def by_hand(texts, facts, k):
    out = {}
    for scope, id_, text in texts:
        found = sorted({(o, f) for s, o, f, x in facts if s == scope and matches(text, x)})
        seen = list(dict.fromkeys(f for _, f in found))[:k]
        if seen:
            out[scope, id_] = seen
    return out


def data():
    rnd = random.Random(3)
    words = ["arroz", "arroces", "paella", "mar", "vistas", "terraza", "menú", "12", "1", "120", "diario", "días", "ab", "xyz", "caña", "Über", "solo", "consolo"]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, n)))
    scopes = ["a", "b", None]
    texts = [(rnd.choice(scopes), k, some(5)) for k in range(80)] + [("a", 900, None), ("a", 901, "word " * 50_000 + "paella"), ("none", 902, "arroz")]
    facts = [(rnd.choice(scopes), rnd.randint(0, 5), f"f{k:02}", some(4)) for k in range(60)] + [("a", 0, "null", None), ("c", 0, "f00", "arroz")]
    return texts, facts


def test_bindings_match_brute_force(spark):
    texts, facts = data()
    t = spark.createDataFrame(texts, "scope string, id int, text string").repartition(3)
    f = spark.createDataFrame(facts, "scope string, ord int, fact string, text string").repartition(2)
    for k in (8, 2):
        got = {(r.scope, r.id): list(r.supported_by) for r in bindings.bindings(t, f, k).collect()}
        assert got == by_hand(texts, facts, k)
    assert bindings.bindings(t.limit(0), f).collect() == [] == bindings.bindings(t, f.limit(0)).collect()


def test_completed_claims(spark):
    texts, facts = data()
    rnd = random.Random(4)
    known = {s: [f for sc, _, f, _ in facts if sc == s] for s in ("a", "b", None, "none")}
    claims = {(s, i): [rnd.choice([*known[s][:4], "made-up"]) for _ in range(rnd.randint(0, 3))] for s, i, _ in texts if i % 3}
    t = spark.createDataFrame(texts, "scope string, id int, text string")
    f = spark.createDataFrame(facts, "scope string, ord int, fact string, text string")
    c = spark.createDataFrame([(s, i, ids) for (s, i), ids in claims.items()], "scope string, id int, supported_by array<string>")
    first = by_hand(texts, facts, 8)
    want = {}
    for s, i, _ in texts:
        ids, found = claims.get((s, i)), first.get((s, i))
        if ids is not None and set(ids) <= set(known[s]):
            want[s, i] = ids, "kept"
        elif ids is None:
            want[s, i] = (found[:6], "completed") if found else (None, "unsupported")
        else:
            want[s, i] = (found, "repaired") if found else (ids, "unmatched")
    got = {(r.scope, r.id): (None if r.supported_by is None else list(r.supported_by), r.state) for r in bindings.completed_claims(t, c, f).collect()}
    assert got == want
    assert {state for _, state in want.values()} == {"kept", "completed", "unsupported", "repaired", "unmatched"}


def test_words_meet_by_four_letters_and_once(spark):
    """Against all pairs, with words of one to six letters and numbers; the words of the texts are made once."""
    words = ["a", "7", "42", "x7", "sol", "sola", "solar", "insolar", "consola", "142", "1429", "ab", "abc", "xabc", "abcd", "xabcdy", "ñu", "mar", "mares"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = sorted((t, u) for t in words for u in words if ((len(t) >= 3 or t.isdigit()) and t in u) or (len(u) >= 4 and u in t))
    found = bindings.related_words(df, df)
    assert sorted((r.t, r.u) for r in found.collect()) == want
    starts = found._jdf.queryExecution().optimizedPlan().toString()
    assert starts.count("Join") == 1 and starts.count("LogicalRDD") == 2

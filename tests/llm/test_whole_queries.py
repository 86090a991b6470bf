"""Whole queries and the pipeline against brute force, odd inputs and clashing column names."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from cantera.llm import line_dedup, line_rules, mixing, ngram_join, quality, secrets, token_counts
from cantera.llm import queries as registry
from cantera.llm.shared import table

from .test_corpus_operators import groups

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_quality_matches_brute_force(spark):
    """Dictionaries, differences, calibration and scores, made again without Spark."""
    rnd = random.Random(3)
    good = lambda: " ".join(rnd.choice("river stone quiet garden window letter morning".split()) for _ in range(rnd.randint(20, 400)))
    bad = lambda: " ".join(rnd.choice("$$$ WIN!! click### buy>> free%%".split()) for _ in range(rnd.randint(20, 400)))
    rows = [(k, good() if k % 3 else bad()) for k in range(240)]
    docs = spark.createDataFrame([*rows, (900, ""), (901, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(200)] * 2 + [(5, None), (None, 1)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    ids = spark.range(200).select("id", quality.held_out("id").alias("out"), (F.pmod(F.xxhash64(F.lit(2), F.col("id").cast("string")), F.lit(2)) == 1).alias("odd")).collect()
    fit = {r.id: r.odd for r in ids if not r.out}
    text = {k: (t or "").encode() for k, t in [*rows, (900, ""), (901, None)]}
    samples = {y: [text[k][i : i + quality.CHUNK] for k in sorted(fit, key=str) if not fit[k] and int(k % 3 > 0) == y for i in range(0, len(text[k]), quality.CHUNK)] for y in (1, 0)}
    size = {y: max(1024, min(quality.DICT_BYTES, sum(map(len, samples[y])) // 3)) for y in samples}
    dicts = {y: zstandard.train_dictionary(size[y], samples[y], level=quality.LEVEL) for y in samples}
    press = {y: zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=dicts[y], write_content_size=False, write_checksum=False, write_dict_id=False).compress for y in dicts}
    difference = lambda b: sum(len(press[1](b[i : i + quality.CHUNK])) - len(press[0](b[i : i + quality.CHUNK])) for i in range(0, len(b), quality.CHUNK)) / (len(b) + 1)
    x, y = (np.array(v, float) for v in zip(*[(difference(text[k]), k % 3 > 0) for k in fit if fit[k]], strict=True))
    prior = (sum(k % 3 > 0 for k in fit) + 1) / (len(fit) + 2)
    mean, scale = x.mean(), x.std() + 1e-9
    z = (x - mean) / scale
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    a = b = 0.0
    for _ in range(20_000):  # plain descent on the weighed log loss with the ridge
        p = 1 / (1 + np.exp(-(a * z + b)))
        a += 0.05 * ((weight * (y - p) * z).sum() - 0.01 * a)
        b += 0.05 * ((weight * (y - p)).sum() - 0.01 * b)
    for k, t in text.items():
        want = 1 / (1 + np.exp(-(a * (difference(t) - mean) / scale + b)))
        assert abs(got[k].score - want) < 1e-3, (k, got[k].score, want)
        assert got[k].predicted == int(got[k].score >= 0.7)


def test_mix_matches_brute_force(spark):
    """Targets by filling up, words by walking each source's stream, blocks by the golden-ratio points."""
    rnd = random.Random(8)
    rows = [(k, " ".join(["w"] * rnd.choice([0, 1, 7, 40, 900])), rnd.choice(["a", "a", "a", "b", "c", "d", None])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    size = {k: len(t.split()) for k, t, _ in rows}
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    held = {s: sum(size[k] for k, _, x in rows if x == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    budget = 1.5 * sum(held.values())
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * held[s]}
        if not full:
            break
        target |= {s: 2.0 * held[s] for s in full}
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    want = {}
    for s in names:
        at = 0
        for k in sorted((k for k, _, x in rows if x == s), key=lambda k: hashlib.md5(f"0:{k}".encode()).hexdigest()):
            want[k] = sum(max(0, min(at + e * held[s] + size[k], round(target[s])) - min(at + e * held[s], round(target[s]))) for e in (0, 1))
            at += size[k]
    got = mixing.mix(docs).collect()
    assert {r.doc_id: r.taken for r in got} == want
    assert all(abs(r.target - target[{k: s for k, _, s in rows}[r.doc_id]]) < 1e-6 for r in got)
    # The slots of a source are those whose points fall in its share of the unit interval.
    drawn = mixing.schedule(docs).select("slot", "source").distinct().collect()
    edges = np.cumsum([0] + [target[s] for s in names]) / sum(target.values())
    points = (np.arange(len(names) * mixing.SLOTS_PER_SOURCE, dtype=np.uint64) * np.uint64(mixing.PHI) % np.uint64(1 << 32)) / 2**32
    for r in drawn:
        k = names.index(r.source)
        assert edges[k] - 1e-4 <= points[r.slot] <= edges[k + 1] + 1e-4


@needs_data
def test_ngram_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in registry.QUERIES["op7_ngram_jaccard"](spark, SF).collect())
    assert got == Counter(groups(rows))


@needs_data
@pytest.mark.skipif(not os.path.exists(token_counts.VOCABULARY), reason="no vocabulary")
def test_token_query_matches_full_encoding(spark):
    c = token_counts.counter(token_counts.VOCABULARY)
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    for r in registry.QUERIES["op5_token_counts"](spark, SF).collect():
        t = texts[r.doc_id]
        n = len(t)
        now = t[: int(n / 2)] + t[int(n / 2 + 40) :] if n else ""
        now = now[: int(n / 3)] + " edited" + now[int(n / 3) :]
        now = now[:n] + " The end." + now[n:]
        assert r.n_tokens == len(c.encode(t)) and r.n_chars_edited == len(now) and r.n_tokens_edited == len(c.encode(now))


def test_clashing_columns(spark):
    rows = [(1, "One line of text here\nOne line of text here\nother words in this line", 7), (2, None, 8), (3, "", 9)]
    for name in ("_drop", "_id", "_th", "key", "_row", "_lost", "_text", "_words", "_go", "_n", "_copy", "_taken", "_h", "size"):
        docs = spark.createDataFrame(rows, f"doc_id bigint, text string, `{name}` int").withColumn("source", F.lit("s"))
        out = line_dedup.dedup_lines(docs)
        assert out.columns == docs.columns
        if name in ("_drop", "_lost"):
            assert {r.doc_id: (r.text, r[name]) for r in out.collect()} == {1: ("One line of text here\nother words in this line", 7), 2: (None, 8), 3: ("", 9)}
        assert line_rules.clean_lines(docs).columns == docs.columns
        assert ngram_join.keep_one(docs).columns == docs.columns if name == "_h" else True
        assert mixing.mixed(docs).columns == docs.columns if name in ("_n", "_copy") else True
    long = " ".join(f"word{k}" for k in range(60))
    kept = line_rules.clean_lines(spark.createDataFrame([(1, long, 5)], "doc_id bigint, text string, _lost int")).collect()
    assert [(r.doc_id, r._lost) for r in kept] == [(1, 5)]


def test_empty_tables_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.classify(empty, labels).count() == 0 and line_rules.quality_rules(empty).count() == 0
    assert line_dedup.line_groups(empty, min_words=1, max_bits=None).count() == 0
    assert mixing.schedule(empty).count() == 0 and secrets.find_secrets(empty).count() == 0 if hasattr(secrets, "find_secrets") else True
    twice = spark.createDataFrame([(1, "same line of words\nsame line of words", "s")] * 2, "doc_id bigint, text string, source string")
    assert [r.text for r in line_dedup.dedup_lines(twice, min_words=1, max_bits=None).collect()] == ["same line of words"] * 2
    assert [r.n_words for r in line_rules.quality_rules(twice).collect()] == [8, 8]
    assert sorted(r.taken for r in mixing.mix(twice).collect()) == [12, 12] or sum(r.taken for r in mixing.mix(twice).collect()) == 24


def test_very_long_texts(spark):
    words = " ".join(f"w{k % 977}" for k in range(60_000))
    docs = spark.createDataFrame([(1, words), (2, words + " end"), (3, "short text of five words")], "doc_id bigint, text string")
    assert {r.id: r.component for r in ngram_join.similar_groups(docs).collect()} == {1: 1, 2: 1, 3: 3}
    rows = {r.doc_id: r for r in line_rules.quality_rules(docs).collect()}
    assert rows[1].n_words == 60_000 and rows[1].n_repeat_words == 60_000
    kept = line_dedup.line_groups(docs, min_words=1, max_bits=None).collect()
    assert {(r.id, r.keep) for r in kept} == {(1, True), (2, False), (3, True)}


@needs_data
def test_pipeline_run(spark):
    """The rows of run() by brute force from the classifier's verdicts on: groups, passages, draws."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, SF, "documents")
    scores = {r.doc_id: r.predicted for r in quality.classify(docs, table(spark, SF, "labels")).collect()}
    good = [(r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id]]
    firsts = {c for _, _, c in groups(good)}
    out = pipeline.run(spark, SF).collect()
    assert out[0].__fields__ == docs.columns
    ids = Counter(r.doc_id for r in out)
    assert set(ids) <= firsts and max(ids.values()) <= 2
    texts = dict(good)
    same = sum(r.text == texts[r.doc_id] for r in out)
    assert same >= 0.8 * len(out)
    sources = defaultdict(int)
    for r in out:
        sources[r.source] += 1
    assert len(sources) > 1

"""Quality classifier by compression.

Two zstandard dictionaries are built, from text labelled good and from text labelled bad.
A text is cut into chunks, each chunk is compressed with either dictionary, and the
difference of the compressed sizes per byte becomes a score through a logistic calibration
that is fitted on other labelled rows.

The fit takes labelled rows below a limit of a hash of their id, about ``FIT_ROWS`` of each
label; a second hash deals them to the dictionaries and to the calibration. A dictionary is
built from chunks of whole texts below a limit of a hash of id and place, about
``SAMPLE_BYTES`` of each label. Chunks and one difference for each calibration row come to
the driver, so what it holds is bounded by these two parameters whatever the corpus.
Scoring covers every chunk of every text.

Defined results: a null text scores as an empty one; an empty text scores by the
intercept at no difference; without rows of both labels every score is the smoothed share
of good rows (0.5 without labels). A label row counts once per (id, label); of documents
with one id, the one with the smallest text hash feeds the fit, and all are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, written

CHUNK = 1024
LEVEL = 3
DICT_BYTES = 110_000
#: Bytes of chunks that a dictionary is built from, about.
SAMPLE_BYTES = 3_000_000
#: Labelled rows of each label that the fit looks at, about.
FIT_ROWS = 8_000
THRESHOLD = 0.7


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def chunks(data: bytes, size: int = CHUNK) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def _dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL)
    except zstandard.ZstdError:  # too little text to train on
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class CompressionClassifier:
    """Dictionaries and calibration; small, and shipped to the tasks as bytes."""

    def __init__(self, good: list[bytes], bad: list[bytes], prior: float):
        self.prior = prior
        self.weights: np.ndarray | None = None
        self.mean = self.scale = 0.0
        # A third of the sample at most goes into a dictionary, so that it generalises.
        size = lambda xs: max(1024, min(DICT_BYTES, sum(map(len, xs)) // 3))
        self.dicts = [(d.as_bytes(), len(xs) > 0) for xs in (good, bad) for d in [_dictionary(xs, size(xs))]] if good and bad else []
        self._open: list[zstandard.ZstdCompressor] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_open": None}

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if self._open is None:
            self._open = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d, _ in self.dicts]
        return self._open

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """Compressed size with the good dictionary less that with the bad one, per byte."""
        good, bad = (c.compress for c in self._compressors())
        return np.array([sum(len(good(part)) - len(bad(part)) for part in chunks(text)) / (len(text) + 1) for text in texts])

    def calibrate(self, x: np.ndarray, labels: np.ndarray) -> None:
        """Logistic regression on the differences by Newton's method with a small ridge."""
        y = np.asarray(labels, float)
        if not self.dicts or y.min(initial=1) == y.max(initial=0):
            return
        self.mean, self.scale = float(x.mean()), float(x.std()) + 1e-9
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        # The sample holds equal numbers of both labels where it can; rows are weighed back to their share.
        share = np.where(y == 1, self.prior / max(y.mean(), 1e-9), (1 - self.prior) / max(1 - y.mean(), 1e-9))
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (share * (y - p)) - 1e-2 * w
            step = np.linalg.solve(z.T @ (z * (share * p * (1 - p) + 1e-9)[:, None]) + 1e-2 * np.eye(2), grad)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        z = np.c_[(self.differences(texts) - self.mean) / self.scale, np.ones(len(texts))]
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


def _below(share: float, *cols: Column, seed: int) -> Column:
    """Whether a hash of the columns is in the given share of all hashes."""
    return F.lit(True) if share >= 1 else F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) < int(share * (1 << 40))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> CompressionClassifier:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    Rows and chunks are chosen by hashes of ids and places, so the sample does not depend
    on how the tables are dealt.
    """
    marks = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).filter("id is not null and y in (0, 1)").distinct()
    marks = marks.filter(~held_out("id"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    name = F.col("id").cast("string")
    picked = [marks.filter((F.col("y") == y) & _below(FIT_ROWS / max(n, 1), name, seed=1)) for y, n in counts.items()]
    if len(picked) < 2:
        return CompressionClassifier([], [], prior)
    # About 2 * FIT_ROWS ids and marks at most.
    picked = F.broadcast(picked[0].unionByName(picked[1]).withColumn("odd", F.pmod(F.xxhash64(F.lit(2), name), F.lit(2)) == 1))
    body = docs.select(F.col(f"`{doc_id}`").alias("id"), F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8").alias("body"))
    rows = body.join(picked, "id").groupBy("id", "y", "odd").agg(F.min_by("body", F.xxhash64("body")).alias("body"))
    rows = written(rows, "labelled")

    sizes = {r["y"]: r["size"] for r in rows.filter("not odd").groupBy("y").agg(F.sum(F.length("body")).alias("size")).collect()}
    parts = rows.filter("not odd and length(body) > 0").select("id", "y", "body", F.explode(F.expr(f"sequence(0, int((length(body) - 1) / {CHUNK}))")).alias("place"))
    some = F.lit(False)
    for y, size in sizes.items():
        some = some | ((F.col("y") == y) & _below(SAMPLE_BYTES / max(size, 1), F.col("id").cast("string"), F.col("place"), seed=3))
    parts = parts.filter(some).select("id", "y", "place", F.expr(f"substring(body, place * {CHUNK} + 1, {CHUNK})").alias("part"))
    taken = sorted((str(r["id"]), r["y"], r["place"], bytes(r["part"])) for r in parts.toLocalIterator())
    model = CompressionClassifier([t[3] for t in taken if t[1] == 1], [t[3] for t in taken if t[1] == 0], prior)
    if model.dicts:
        pairs = rows.filter("odd").select("id", "y", _udf(model.differences, rows.sparkSession)("body").alias("x")).collect()
        pairs = sorted((str(r["id"]), r["y"], r["x"]) for r in pairs)
        model.calibrate(np.array([p[2] for p in pairs]), np.array([p[1] for p in pairs]))
    return model


def _udf(f: Callable[[list[bytes]], np.ndarray], spark: SparkSession):
    """Column function from texts to doubles; what ``f`` holds is broadcast."""
    held = spark.sparkContext.broadcast(f)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(held.value([t or b"" for t in texts.cast(pa.binary()).to_pylist()]), pa.float64())

    return F.arrow_udf(run, "double")


def score(docs: DataFrame, model: CompressionClassifier, text: str = "text"):
    """Column with the score, 0 to 1, of each whole text."""
    return _udf(model.score, docs.sparkSession)(F.col(f"`{text}`"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    scored = docs.select("doc_id", held_out().alias("held_out"), score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, as they are."""
    return docs.filter(score(docs, fit(docs, labels)) >= threshold)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

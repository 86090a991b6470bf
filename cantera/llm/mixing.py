"""Mixing sources to target weights with a low-discrepancy schedule.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share a budget of
words by weight; a source's target stops at ``MAX_EPOCHS`` times its size and the excess is
shared again. Slot j of the schedule falls at the golden-ratio point frac(j * phi), which
is mapped through the cumulative targets to a source; a source that no point hits gets one
slot at the end. The first ``target`` words of a source's shuffled stream, which starts
over when it ends, are cut into as many blocks as the source has slots, equal to within a
word, and the k-th slot of the source takes the k-th block. So any prefix of the schedule
follows the weights, and every source, however small, meets its target to within half a
word.

Plan: one pass gives the sizes per (source, shuffle bucket); running sums over these few
rows place every bucket in its source's stream, and rows are accumulated within a bucket,
so that no task holds a whole source. Documents are cut at block edges and joined to the
ranked slots on (source, block).

Defined results: a null text has size 0 and takes nothing; a null source is a source of
its own, after all others; an empty table gives an empty result; sources without words get
target 0; repeated rows are separate documents, ordered by (hash, id, size), so that the
result is the same bag of rows in each run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh, n_words, offsets, table, written

#: Fixed weights, repeating in source order.
WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MAX_EPOCHS = 2
#: Slots a source gets on average, if its words allow it, and words of a block at most, about.
SLOTS_PER_SOURCE = 2048
MAX_BLOCK = 1_000_000
#: floor(2**32 / golden ratio): j * PHI mod 2**32 is the golden-ratio sequence.
PHI = 2654435769
TURN = 1 << 32
#: Cells of the unit interval on which slots and sources are joined.
CELLS = 1024
#: Rows of one shuffle bucket, about; buckets, or slots, that are accumulated together.
BUCKET_ROWS = 512
RUN = 4096


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place in code-point order, null last, counted from 0.

    Ranges of sources are counted apart and the counts of the ranges accumulated, so no
    task holds all sources.
    """
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "sources")
    sizes = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}  # one count for each range
    base, at = F.lit(0), 0
    for k in sorted(sizes):
        base = F.when(F.col("_range") == k, F.lit(at)).otherwise(base)
        at += sizes[k]
    inner = Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())
    return dealt.withColumn("rank", F.row_number().over(inner) - 1 + base).drop("_range")


def _targets(ranked: DataFrame) -> tuple[DataFrame, int, int]:
    """Sources with their targets, the number of sources, and the sum of targets."""
    weight: Column = F.lit(WEIGHTS[-1])
    for k, w in enumerate(WEIGHTS[:-1]):
        weight = F.when(F.col("rank") % len(WEIGHTS) == k, F.lit(w)).otherwise(weight)
    rows = written(ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * MAX_EPOCHS), "weights")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    budget = total * BUDGET_PERCENT / 100
    level = 0.0
    while n:
        # Each pass caps the sources that the shared level puts above their limit, and
        # shares what is left among the others; one row of sums comes to the driver.
        open_, full = F.col("cap") > level * F.col("weight"), F.col("cap") <= level * F.col("weight")
        w, held = rows.agg(F.sum(F.when(open_, F.col("weight"))), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0))).first()
        if not w:
            break
        raised = (budget - held) / w
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight"))
    return rows.withColumn("target", target), n, int(budget)


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, drawn): the documents with their targets, and the words that each slot draws of them.

    ``rows`` has doc_id, source, shuffled, start, size, source_size and target; ``drawn`` has
    slot, the schedule's order, source, block, doc_id, shuffled, start and words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), n_words(F.col(f"`{text}`")).alias("size"))
    # The order of the stream: a hash of the id.
    rows = rows.withColumn("shuffled", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = written(rows, "sizes")
    buckets = 1 << max(0, (rows.count() // BUCKET_ROWS)).bit_length()
    hexes = max(1, -(-(buckets.bit_length() - 1) // 4))
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("shuffled", 1, hexes), 16, 10).cast("long") * buckets / (16**hexes)).cast("long"))
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    parts = written(parts, "parts")
    sources = parts.groupBy("source").agg(F.sum("part").alias("source_size"))
    targets, n, budget = _targets(_ranked(sources))
    slots = max(1, n * SLOTS_PER_SOURCE, -(-budget // MAX_BLOCK))
    ranked = _schedule(spark, targets, n, budget, min(slots, max(1, budget)))
    # Slots of each source; its blocks are equal shares of the words that it gives.
    counts = ranked.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("slots"))
    targets = targets.join(counts, targets["source"].eqNullSafe(counts["_s"]), "left").drop("_s").withColumn("words", F.round("target").cast("long"))
    targets = written(targets, "targets")
    extra = targets.filter("slots is null and words > 0").select("source", F.lit(0).cast("long").alias("k"), (F.lit(slots) + F.col("rank")).alias("slot"))
    ranked = ranked.unionByName(extra)
    targets = targets.withColumn("slots", F.coalesce("slots", F.lit(1)))

    placed = offsets(parts.withColumn("run", F.floor(F.col("bucket") / RUN)), ["source"], "run", [F.col("bucket")], "part", "base")
    t = targets.select(F.col("source").alias("_s"), "source_size", "target", "words", "slots")
    placed = placed.join(t, placed["source"].eqNullSafe(t["_s"])).select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "base", "source_size", "target", "words", "slots")
    inner = Window.partitionBy("source", "bucket").orderBy("shuffled", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(placed, rows["source"].eqNullSafe(placed["_s"]) & (rows["bucket"] == placed["_b"])).drop("_s", "_b", "bucket")
    rows = rows.withColumn("start", F.col("base") + F.col("_in")).drop("base", "_in")

    # A document's pieces, one for each pass and block that it touches: block k has the words from k * words / slots.
    passes = rows.filter("size > 0 and words > 0").withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(MAX_EPOCHS)])))
    passes = passes.withColumn("from", F.col("start") + F.col("epoch") * F.col("source_size"))
    passes = passes.withColumn("upto", F.least(F.col("from") + F.col("size"), "words")).filter("`from` < upto")
    edge = lambda k: F.expr(f"bigint(({k}) * cast(words as decimal(18, 0)) div slots)")
    block = lambda at: F.expr(f"bigint(((({at}) + 1) * cast(slots as decimal(18, 0)) - 1) div words)")
    cut = passes.withColumn("block", F.explode(F.sequence(block("`from`"), block("upto - 1"))))
    cut = cut.withColumn("words", F.least("upto", edge("block + 1")) - F.greatest("from", edge("block"))).filter("words > 0")
    c = ranked.select(F.col("source").alias("_s"), F.col("k").alias("_k"), "slot")
    drawn = cut.join(c, cut["source"].eqNullSafe(c["_s"]) & (cut["block"] == c["_k"]))
    out = ["doc_id", "source", "shuffled", "start", "size", "source_size", "target"]
    return rows.select(*out), drawn.select("slot", "block", "words", *out)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words that the slots draw, for every document."""
    rows, drawn = pieces(docs, doc_id, text, source, seed)
    out = ["doc_id", "source", "shuffled", "start", "size", "source_size", "target"]
    none = F.lit(0).cast("long")
    both = drawn.select(*out, "words").unionByName(rows.select(*out, none.alias("words")))
    # Rows that repeat have starts of their own, but for those without words.
    taken = both.groupBy(*out).agg(F.sum("words").alias("taken"), F.count_if(F.col("words") == 0).alias("n"))
    taken = taken.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def schedule(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """slot, source, doc_id and words: what the mix draws, in the order of slots."""
    return pieces(docs, doc_id, text, source, seed)[1].select("slot", "source", "doc_id", "words")


def _schedule(spark: SparkSession, targets: DataFrame, n: int, budget: int, slots: int) -> DataFrame:
    """(source, k, slot): the slots of each source in their order."""
    # Share of each source in the unit interval, by its rank; sums over the sources only.
    parts = -(-n // RUN)
    t = targets.withColumn("part", F.floor(F.col("rank") / RUN).cast("int"))
    sums = t.groupBy("part").agg(F.sum("target").alias("s"))
    earlier = {r["part"]: r["s"] for r in sums.collect()} if parts > 1 else {}
    base, at = F.lit(0.0), 0.0
    for k in sorted(earlier):
        base = F.when(F.col("part") == k, F.lit(at)).otherwise(base)
        at += earlier[k]
    upto = F.sum("target").over(Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) + base
    scale = F.lit(TURN / max(1.0, float(budget)))
    t = t.withColumn("hi", F.least(F.lit(TURN), F.floor(upto * scale).cast("long")))
    t = t.withColumn("lo", F.when(F.col("rank") == 0, F.lit(0)).otherwise(F.least(F.lit(TURN), F.floor((upto - F.col("target")) * scale).cast("long"))))
    t = t.filter("hi > lo and source_size > 0")
    width = TURN // CELLS
    cells = t.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.col("id") * PHI, F.lit(TURN)).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / width))
    placed = written(points.join(cells, "cell").filter("point >= lo and point < hi").select("source", "slot", F.floor(F.col("slot") / RUN).alias("run"), F.lit(1).alias("one")), "slots")
    # Rank of each slot within its source: slots are counted by runs of slots first.
    return offsets(placed, ["source"], "run", [F.col("slot")], "one", "k").select("source", F.col("k").cast("long").alias("k"), "slot")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, whole, once or twice, in their own columns.

    A document is kept once if at least half of its words are taken, and twice if at least
    one and a half times its words are; a document without words is kept once.
    """
    n, copy, other, size, most = fresh(docs, "_n", "_copy", "_id", "_size", "_taken")
    takes = mix(docs).groupBy(F.col("doc_id").alias(other), F.col("size").alias(size)).agg(F.max("taken").alias(most))
    sized = docs.withColumn(n, n_words(F.col("text")))
    rows = sized.join(takes, F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(n) == F.col(size)))
    times = F.when(F.col(n) == 0, F.lit(1)).otherwise(F.floor(F.col(most) / F.col(n) + 0.5).cast("int"))
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(0), times))).filter(F.col(copy) > 0)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))

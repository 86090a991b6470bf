"""Claims bound to the facts that back them.

A fact matches a text if a word of the text (of three letters, or a number) is part of one
of its words, or a word of the fact (of four letters) is part of one of the text's. Both are
relations between words, so they are found once between the two vocabularies: a short word
meets longer ones on its first four letters, which are one of their n-grams, and is verified. An
inverted index then gives, for each word of a text, the first ``k`` facts of its scope, and
a text merges the lists of its words. Only the first ``k`` of a word can be among the first
``k`` of a text, so every step keeps ``k`` rows a key, before the shuffle too, however many
facts have a common word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantera.functions.text import fold

GRAM = 4
#: Facts that an existing claim, and a new one, may cite.
REPAIRED, COMPLETED = 8, 6


def _words(text: Column) -> Column:
    folded = F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"\bdiari[oa]s?\b", "dias")
    return F.array_distinct(F.filter(F.split(folded, " "), lambda w: w != ""))


def _grams(word: Column, *lengths: int) -> Column:
    """What a contained word may start with."""
    of = lambda n: F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda k: F.substring(word, k, F.lit(n))))
    return F.array_distinct(F.flatten(F.array_compact(F.array(*[of(n) for n in lengths]))))


def related_words(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """(t, u): words t of texts and u of facts of which one is part of the other, as the rule has it.

    Both directions meet in one join, so that the words of the texts are made once for it.
    """
    number = F.col("word").rlike(r"^\d+$")
    word = F.col("word")

    def roles(words: DataFrame, name: str, short: Column, into: bool, grams: Column) -> DataFrame:
        """A word by its first letters where it may be the shorter, and by what such a word of the other side may start with."""
        sides = F.array(F.when(short, F.struct(F.lit(into).alias("into"), F.array(F.substring(word, 1, F.lit(GRAM))).alias("grams"))), F.struct(F.lit(not into).alias("into"), grams.alias("grams")))
        rows = words.select("word").distinct().select(word.alias(name), F.explode(F.array_compact(sides)).alias("_side"))
        return rows.select(name, F.col("_side.into").alias("into"), F.explode("_side.grams").alias("gram"))

    # Words of texts that are shorter than a gram are numbers, or of three letters; those of facts are as long.
    t = roles(texts, "t", (F.length(word) >= 3) | number, True, _grams(word, GRAM))
    u = roles(facts, "u", F.length(word) >= GRAM, False, F.array_union(F.filter(_grams(word, 1, 2), lambda g: g.rlike(r"^\d+$")), _grams(word, 3, GRAM)))
    # A word that both have meets itself in one direction only.
    part = F.when(F.col("into"), F.contains("u", F.col("t"))).otherwise(F.contains("t", F.col("u")) & (F.col("t") != F.col("u")))
    return t.join(u, ["into", "gram"]).where(part).select("t", "u")


def _first(df: DataFrame, by: list[str], k: int) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy("ord", "fact"))).where(F.col("_nth") <= k).drop("_nth")


def bindings(texts: DataFrame, facts: DataFrame, k: int = REPAIRED) -> DataFrame:
    """(scope, id, supported_by): the first ``k`` facts, by (ord, fact), of each text that has any.

    texts: (scope, id, text); facts: (scope, ord, fact, text). Scopes are compared with each
    other only if equal, null to null. Null texts match nothing; of facts that repeat an id
    in a scope the first counts; repeated texts of one id are one.
    """
    t = texts.select(F.coalesce(F.col("scope").cast("string"), F.lit("\0")).alias("_scope"), "id", F.explode(_words(F.col("text"))).alias("word"))
    u = facts.select(F.coalesce(F.col("scope").cast("string"), F.lit("\0")).alias("_scope"), "ord", "fact", F.explode(_words(F.col("text"))).alias("word"))
    related = related_words(t, u)
    by_word = _first(u.groupBy("_scope", "word", "fact").agg(F.min("ord").alias("ord")), ["_scope", "word"], k)
    index = by_word.join(related, F.col("word") == F.col("u")).groupBy("_scope", "t", "fact").agg(F.min("ord").alias("ord"))
    index = _first(index, ["_scope", "t"], k).withColumnsRenamed({"_scope": "_of"})
    hits = t.join(index, (F.col("_scope") == F.col("_of")) & (F.col("word") == F.col("t"))).groupBy("_scope", "id", "fact").agg(F.min("ord").alias("ord"))
    found = _first(hits, ["_scope", "id"], k).groupBy("_scope", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "fact"))), lambda x: x["fact"]).alias("supported_by"))
    return found.select(F.nullif(F.col("_scope"), F.lit("\0")).alias("scope"), "id", "supported_by")


def completed_claims(leaves: DataFrame, claims: DataFrame, facts: DataFrame) -> DataFrame:
    """(scope, id, supported_by, state) for every leaf text.

    leaves: (scope, id, text); claims: (scope, id, supported_by) of leaves that have one. A
    claim whose ids are all facts of its scope is ``kept``; another is ``repaired`` with the
    first facts that match its text, or stays, ``unmatched``; a leaf without a claim gets one
    with fewer facts, ``completed``, or stays without, ``unsupported``.
    """
    key = ["scope", "id"]
    cited = claims.select(*key, F.explode_outer(F.array_distinct("supported_by")).alias("fact"))
    known = facts.select(F.col("scope").alias("_scope"), F.col("fact").alias("_fact")).distinct()
    cited = cited.join(known, F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("fact") == F.col("_fact")), "left")
    valid = cited.groupBy(*key).agg(F.bool_and(F.col("_fact").isNotNull() | F.col("fact").isNull()).alias("valid"))
    state = claims.join(valid.withColumnsRenamed({c: f"_{c}" for c in key}), F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("id") == F.col("_id"))).drop("_scope", "_id")
    rows = leaves.join(state.withColumnsRenamed({"scope": "_scope", "id": "_id"}), F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("id") == F.col("_id")), "left").drop("_scope")
    rows = rows.withColumnRenamed("_id", "_has")
    found = bindings(rows.where("valid IS NULL OR NOT valid").select(*key, "text"), facts, REPAIRED).withColumnsRenamed({"scope": "_scope", "id": "_id", "supported_by": "_found"})
    rows = rows.join(found, F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("id") == F.col("_id")), "left")
    matched, new = F.col("_found").isNotNull(), F.col("_has").isNull()
    name = F.when(F.col("valid"), "kept").when(new & matched, "completed").when(new, "unsupported").when(matched, "repaired").otherwise("unmatched")
    ids = F.when(F.col("valid") | ~matched, F.col("supported_by")).when(new, F.slice("_found", 1, COMPLETED)).otherwise(F.col("_found"))
    return rows.select(*key, ids.alias("supported_by"), name.alias("state"))

"""Images of pages and the places that they name without having been checked."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cantera.functions.html import Element, elements
from cantera.functions.text import contains_phrase, fold

#: Distinct places that are sent to all tasks; more are shuffled.
MOST_PLACES = 50_000

IMAGE = "src string, alt string, caption string, origin string, verified boolean"


def _figure(e: Element) -> Element | None:
    return next((x for x in e.up() if x.tag == "figure"), None)


def images_of(html: str) -> list[tuple]:
    """(src, alt, caption, origin, verified) of the images of a page, each once, in order; the caption is that of the figure around it."""
    captions: dict[int, list[str]] = {}
    seen: list[Element] = []

    def wanted(e: Element) -> bool:
        if e.tag == "img":
            seen.append(e)
        return "data-image-caption" in e.attributes

    for e in elements(html, wanted):
        figure = _figure(e)
        if figure is not None:
            captions.setdefault(id(figure), []).append(" ".join(e.text))
    rows = [(e.attributes.get("src", "(sin src)"), e.attributes.get("alt"), " ".join(" ".join(captions.get(id(_figure(e)), [])).split()), e.get("data-image-origin") or None, e.get("data-place-verified") == "true") for e in seen]
    return list(dict.fromkeys(rows))


def page_images(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, the columns of ``IMAGE``) of pages (key, html)."""
    names = [x.split()[0] for x in IMAGE.split(", ")]
    kinds = [pa.string()] * 4 + [pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, html in enumerate(batch.column(1)):
                found = images_of(html.as_py() or "")
                at += [k] * len(found)
                rows += found
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], [key, *names])

    return pages.select(key, "html").mapInArrow(run, StructType([pages.schema[key], *StructType.fromDDL(IMAGE).fields]))


def unverified_places(images: DataFrame, places: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, rule, detail): images with an origin whose alternative text or caption names a place, as whole words, without a checked place.

    places: (place). A text meets the places whose first word it has, and is verified.
    """
    needles = places.select("place", fold(F.col("place")).alias("needle")).where("needle <> ''").dropDuplicates(["place"]).withColumn("first", F.substring_index("needle", " ", 1))
    text = fold(F.concat_ws(" ", F.coalesce("alt", F.lit("")), F.coalesce("caption", F.lit(""))))
    rows = images.where("coalesce(origin, '') <> '' AND NOT verified").select(key, "src", text.alias("text"))
    words = rows.withColumn("first", F.explode(F.array_distinct(F.split("text", " "))))
    # The words of all texts are never the side that is sent to all tasks.
    few = needles.limit(MOST_PLACES + 1).count() <= MOST_PLACES
    found = words.join(F.broadcast(needles) if few else needles.hint("merge"), "first").where(contains_phrase(F.col("text"), F.col("needle"))).groupBy(key, "src", "text").agg(F.array_sort(F.collect_set("place")).alias("named"))
    return found.select(key, F.lit("image-place-unverified").alias("rule"), F.concat(F.col("src"), F.lit(": "), F.array_join("named", ", ")).alias("detail"))

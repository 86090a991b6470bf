"""Queries of images that name places, over pages made of all parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantera.operators import images
from cantera.operators.pairs import scattered

from .registry import query


def part_figures(t):
    """A page for each part: a picture whose text names it, and its caption the brand; places are the parts of the largest sizes."""
    c, lit = F.col, F.lit
    html = F.concat(
        lit('<figure><img src="/'), "p_partkey", lit('.jpg" alt="Foto > de '), "p_name", lit(', "'), F.when(c("p_type") != "PROMO", " data-image-origin=propia").otherwise(""), F.when(c("p_type") == "LARGE", ' data-place-verified="true"').otherwise(""),
        lit("><figcaption><span data-image-caption>Marca "), "p_brand", lit("</span> credito</figcaption></figure><img src='/x.jpg' data-image-origin=stock>"),
    )
    places = t("part").where("p_size > 46").select(F.initcap("p_name").alias("place")).unionByName(t("part").where("p_size = 46").select(F.replace("p_brand", lit("#"), lit(" ")).alias("place")))
    return t("part").select(c("p_partkey").alias("page_id"), html.alias("html")), places


@query("""
SELECT page_id, src, alt, caption, origin, verified FROM (
  SELECT p_partkey AS page_id, '/' || p_partkey || '.jpg' AS src, 'Foto > de ' || p_name || ', ' AS alt, 'Marca ' || p_brand AS caption, CASE WHEN p_type <> 'PROMO' THEN 'propia' END AS origin, p_type = 'LARGE' AS verified FROM part
  UNION ALL SELECT p_partkey, '/x.jpg', NULL, '', 'stock', false FROM part)
""")
def page_images(spark, t):
    return images.page_images(part_figures(lambda name: scattered(t(name)))[0])


@query("""
WITH places AS (SELECT DISTINCT p_name AS place, lower(p_name) AS needle FROM part WHERE p_size > 46 UNION SELECT DISTINCT replace(p_brand, '#', ' '), lower(replace(p_brand, '#', ' ')) FROM part WHERE p_size = 46),
x AS (SELECT p_partkey AS page_id, ' foto de ' || p_name || ' marca ' || lower(replace(p_brand, '#', ' ')) || ' ' AS text FROM part WHERE p_type NOT IN ('PROMO', 'LARGE'))
SELECT page_id, 'image-place-unverified' AS rule, '/' || page_id || '.jpg: ' || string_agg(CASE WHEN starts_with(needle, 'brand') THEN place ELSE upper(place[1]) || split_part(place[2:], ' ', 1) || ' ' || upper(split_part(place, ' ', 2)[1]) || split_part(place, ' ', 2)[2:] END, ', ' ORDER BY CASE WHEN starts_with(needle, 'brand') THEN place ELSE upper(place[1]) || place[2:] END) AS detail
FROM x JOIN places ON contains(text, ' ' || needle || ' ') GROUP BY page_id
""")
def image_places(spark, t):
    pages, places = part_figures(t)
    return images.unverified_places(images.page_images(pages), places)

"""Images of pages and the places they name."""

from cantera.operators import images


def test_images_and_captions():
    html = '<figure><img src="a.jpg" alt="A > B" data-image-origin="propia"><img src=b.jpg data-place-verified=true><figcaption>x <b data-image-caption>Vista de <i>la</i>  cala</b><b data-image-caption>y más</b></figcaption></figure><img src="c.jpg"><img><img src="c.jpg">'
    assert images.images_of(html) == [("a.jpg", "A > B", "Vista de la cala y más", "propia", False), ("b.jpg", None, "Vista de la cala y más", None, True), ("c.jpg", None, "", None, False), ("(sin src)", None, "", None, False)]
    assert images.images_of("") == []


def test_places_without_a_check(spark):
    rows = [(1, "Playa de Levante.", "Cala Finestrat", "propia", False), (2, "levantera", None, "propia", False), (3, "Levante", None, None, False), (4, "Levante", None, "stock", True), (5, None, "en la cala  finestrat, sí", "stock", False), (6, None, None, "stock", False)]
    df = spark.createDataFrame([(k, f"{k}.jpg", *r) for k, *r in rows], "page_id int, src string, alt string, caption string, origin string, verified boolean")
    places = spark.createDataFrame([("Levante",), ("Cala Finestrat",), ("CÁLA finestrat",), ("!",), (None,)], "place string")
    got = {r.page_id: r.detail for r in images.unverified_places(df, places).collect()}
    assert got == {1: "1.jpg: Cala Finestrat, CÁLA finestrat, Levante", 5: "5.jpg: Cala Finestrat, CÁLA finestrat"}

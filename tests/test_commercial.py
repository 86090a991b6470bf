"""Commercial extraction: the tokenizer, items of markup, structured data with its guard, lines of texts."""

import json

import duckdb
import pytest

from cantera import plans
from cantera.functions.html import elements
from cantera.operators import commercial

LD = '<script type="application/ld+json">{}</script>'


def items(html):
    found = [commercial.markup_item(e, "https://x.example/a/") for e in elements(html, commercial._wanted, commercial.NAMED)]
    return [x for x in found if x]


def test_tokenizer():
    html = '<!DOCTYPE html><p>one<p title="a>b">two <br>three<div>x<ul><li>a<li>b<ul><li>c</ul>d</ul></div><script>if (a<b) "<li>"</script><td>t</td></nope>&amp;&eacute;'
    assert [" ".join(e.text) for e in elements(html, lambda e: e.tag in ("p", "li"))] == ["one", "two  three", "a", "b c d", "c"]
    assert [e.attributes for e in elements(html, lambda e: e.tag == "p")] == [{}, {"title": "a>b"}]
    assert [x.tag for x in elements("<a><b><c>", lambda e: e.tag == "c")[0].up()] == ["c", "b", "a", ""]
    assert "".join(elements("<p>&amp;&eacute;&#x41;<b>z", lambda e: e.tag == "p")[0].text) == "&éAz"
    assert elements("", lambda e: True) == []


def test_items_of_markup():
    assert items('<h2>Menú</h2><ul><li>Arroz a banda 14,50 €</li><li>Dos 1 € o 2 €</li><li>Todos los arroces</li></ul>') == [("Arroz a banda", "product", 14.5, "14,50 €", None, None)]
    assert items('<div class="services"><article><h3>Corte</h3> desde 12 € <a href="../b">ver</a></article></div>') == [("Corte", "service", 12.0, "desde 12 €", "from", "https://x.example/b")]
    assert items('<section id="especialidades"><div class="menu-item">Fideuá</div><div>Nada</div><li>Sin precio</li></section>') == [("Fideuá", "specialty", None, None, None, None)]
    assert items('<nav class="menu"><li>Inicio 5 €</li></nav><ul class="carta"><li>Precio 3 €</li><li>Lunes a viernes: 09:00 - 10:00 3 €</li><li data-name="Vino">' + "x" * 300 + "</li></ul>") == []
    # The heading of another list and the class of a parent four levels up don't count.
    assert items('<div class="carta"><div><div><div><ul><li>Lejos 5 €</li></ul></div></div></div></div><div><h2>Carta</h2></div><ul><li>Otra 5 €</li></ul>') == []
    assert items('<table class="tarifas"><tr><td>Masaje<td>30 EUR<tr><th>x</table>') == [("Masaje", "service", 30.0, "30 EUR", None, None)]


def page(spark, *htmls, expected=None):
    rows = [(k, f"https://x.example/{k}", h, expected) for k, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id int, url string, html string, expected string")


def test_structured_data(spark):
    hall = {"@type": ["Thing", "Restaurant"], "name": "Casa Núñez", "makesOffer": [{"@type": "Product", "name": "Pan", "offers": [None, {"price": "1,50", "priceCurrency": "eur", "url": "http://o.example"}, {"price": 9, "priceCurrency": "EUR"}]}]}
    other = {"@type": "Store", "name": "Otra", "x": {"@type": "Product", "name": "Suyo", "offers": {"price": 3, "priceCurrency": "EUR"}}}
    htmls = [
        LD.format(json.dumps({"@graph": [hall, {"@type": "Service", "name": "Boda", "offers": {"price": 0, "priceCurrency": "EUR"}}, {"@type": "Menu", "name": "Carta"}, {"@type": "OpeningHoursSpecification", "dayOfWeek": "https://schema.org/Monday", "opens": "09:00", "closes": "10:00"}]})),
        "<SCRIPT type='application/json'>" + json.dumps([{"name": "Suelto", "price": 2}, {"name": "Sin nada"}, {"name": "USD", "offers": {"price": 2, "priceCurrency": "USD"}}]) + "</SCRIPT>" + LD.format("{bad") + LD.format('{"@type": "Product", "name": "' + "x" * 1_000_001 + '"}'),
        LD.format(json.dumps(other)) + LD.format(json.dumps({"deep": [[hall]]})) + '<ul class="carta"><li>De nadie 5 €</li></ul>',
        None, "", "<p>nada</p>", LD.format('{"@type": "Offer", "name": "Oferta suelta", "price": 5, "priceCurrency": "EUR"}'),
    ]
    made, hours, guards = commercial.structured(page(spark, *htmls, expected="Restaurante casa nunez"), expected="expected")
    got = {(r.page_id, r.name, r.kind, r.amount, r.raw, r.url, r.format) for r in made.collect()}
    assert got == {
        (0, "Pan", "product", 1.5, "1,50 EUR", "http://o.example", "json-ld"), (0, "Boda", "service", None, None, "https://x.example/0", "json-ld"),
        (1, "Suelto", "product", None, None, "https://x.example/1", "embedded-json"), (1, "USD", "product", None, None, "https://x.example/1", "embedded-json"),
        (2, "Pan", "product", 1.5, "1,50 EUR", "http://o.example", "json-ld"), (6, "Oferta suelta", "product", 5.0, "5 EUR", "https://x.example/6", "json-ld"),
    }
    assert [(r.page_id, r.value) for r in hours.collect()] == [(0, "Monday: 09:00-10:00")]
    assert {(r.page_id, r.several, r.target and r.target.path) for r in guards.collect() if r.several} == {(2, True, "deep[0][0]")}
    items_, _, summary = commercial.commercial(page(spark, *htmls), expected=None)
    assert {r.name for r in items_.where("page_id = 2").collect()} == set()
    assert {r.page_id: list(r.discarded) for r in summary.collect() if r.discarded} == {2: ["ambiguous-structured-data", "markup-of-several-businesses"]}
    assert summary.count() == 7


def test_best_of_equal_items_and_limit(spark):
    menu = {"@graph": [{"@type": "MenuItem", "name": "Café"}, {"@type": "MenuItem", "name": "CAFE", "offers": {"price": 2, "priceCurrency": "EUR"}}, {"@type": "MenuItem", "name": "café", "offers": {"price": 3, "priceCurrency": "EUR"}}]}
    html = LD.format(json.dumps(menu)) + '<ul class="carta"><li>Café 9 €</li>' + "".join(f"<li>Plato {k:03} 5 €</li>" for k in range(120)) + "</ul>"
    items_, _, summary = commercial.commercial(page(spark, html))
    rows = sorted(items_.collect(), key=lambda r: r.pos)
    assert len(rows) == 100 and (rows[0].name, rows[0].amount, rows[0].format) == ("CAFE", 2.0, "json-ld") and rows[99].name == "Plato 098"
    (row,) = summary.collect()
    assert (row.json_ld, row.html, row.prices, row.specialties, list(row.discarded)) == (1, 99, 100, 0, ["over-limit:21"])
    assert commercial.commercial(page(spark, html).limit(0))[2].collect() == []


def test_lines(spark):
    text = "Antes 3 €\nCarta\nArroz 12 €\nDos 1 € 2 €   Vino desde 4,50 €\nServicios: Boda 100 €\nEspecialidades\n" + "x" * 230 + " 5 €\nPrecio 4 €\nFideuá 15 EUR"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = [(r.name, r.kind, r.amount, r.qualifier) for r in sorted(commercial.text_items(df, "id").collect(), key=lambda r: r.pos)]
    assert got == [("Arroz", "product", 12.0, None), ("Vino", "product", 4.5, "from"), ("Boda", "service", 100.0, None), ("Fideuá", "specialty", 15.0, None)]


@pytest.mark.parametrize("other", ["MEDIUM", "PROMO"])
def test_summary_of_more_items_than_a_page_may_have(spark, tmp_path, other):
    kinds = {"LARGE": 70, "SMALL": 60, other: 1}
    rows = [(k, f"{'abcdefgh'[j // 10]}{'klmnopqrst'[j % 10]} part", "Brand#1", kind, 7, 900.0 + j) for k, (kind, j) in enumerate((kind, j) for kind, n in kinds.items() for j in range(n))]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    want = duckdb.sql(plans.ORACLES["commercial_summary"].replace("FROM part)", f"FROM '{tmp_path}/part.parquet/*.parquet')")).fetchall()
    got = [tuple(r) for r in plans.QUERIES["commercial_summary"](spark, str(tmp_path)).collect()]
    assert got == want and got[0][4] == 100

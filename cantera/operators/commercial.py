"""What a business sells, from its pages and texts: structured data, semantic markup, plain lines.

Structured data is read by joins over the objects of ``json_walk``, with a guard: if a page
names several businesses, only what stands within the one of the expected name counts.
Markup is read by a tokenizer in Arrow tasks, one item and one price at most an element.
Lines of texts (of PDFs, say) take their kind from the last heading before them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cantera.functions import extract
from cantera.functions.html import Element, elements
from cantera.functions.text import decode_entities, fold, html_to_text, once
from cantera.operators.nested import json_walk

# Schema types of businesses and of what they sell.
BUSINESS_TYPES = ("LocalBusiness", "Restaurant", "CafeOrCoffeeShop", "Store", "Hotel", "LodgingBusiness", "FoodEstablishment", "ProfessionalService", "HealthAndBeautyBusiness")
COMMERCIAL_TYPES = ("Menu", "MenuSection", "MenuItem", "Product", "Offer", "AggregateOffer", "Service", "OpeningHoursSpecification")
# Words of headings and class names around items, names that aren't, and formats, best last.
CONTEXT = r"(?i)\b(?:menu|men[uú]|carta|productos?|products?|cat[aá]logo|catalog|servicios?|services?|tratamientos?|treatments?|tarifas?|prices?|especialidades?|specialties?)\b"
SERVICE_CONTEXT = r"(?i)\b(?:servicios?|services?|tratamientos?|treatments?|tarifas?)\b"
SPECIALTY_CONTEXT = r"(?i)\b(?:especialidades?|specialties?)\b"
GENERIC_NAME = r"(?i)^(?:menu|men[uú]|carta|productos?|servicios?|tarifas?|precio|price|ver m[aá]s|more)$"
EXPLICIT_ITEM = r"(?i)(?:^|[-_\s])(?:(?:menu|product|service|treatment|catalog)[-_\s]?(?:item|card|entry|row)|single[-_\s]?(?:menu|product|service))(?:$|[-_\s])"
ITEM_TYPE = r"(?i)schema\.org/(?:Product|Service|MenuItem)"
DESCRIPTIVE = r"(?i)^(?:todos?|todas?|nuestros?|nuestras?|los precios|elige|escoge|servidos?|acompa[nñ]ados?|incluye[n]?)\b"
HEADING = r"(?i)^(menu|men[uú]|carta|productos?|products?|cat[aá]logo|catalog|servicios?|services?|tratamientos?|treatments?|especialidades?|specialties?)\b[:\-]?\s*"
EDGES = r"^[|•·:;\-–]+|[|•·:;\-–]+$"
FORMATS = ("pdf", "html", "embedded-json", "json-ld")
DIMENSIONS = ("products", "services", "specialties", "prices", "openingHours")
NAMED = ("h1", "h2", "h3", "h4", "strong", "b", "td")
ASIDE = frozenset(("nav", "header", "footer", "aside"))
#: Characters of a script beyond which it isn't read; items a page may have; characters of an element's text and a line.
SCRIPT_CHARS, ITEMS, ELEMENT_CHARS, LINE_CHARS = 1_000_000, 100, 260, 220

ITEM = "name string, kind string, amount double, raw string, qualifier string, url string"


def valid_name(name: Column) -> Column:
    return F.length(name).between(2, 100) & ~name.rlike(GENERIC_NAME) & name.rlike("[A-Za-zÀ-ÿ]")


def clean_name(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.trim(F.regexp_replace(decode_entities(text), r"\s+", " ")), EDGES, "")), 1, 120)


# ---- markup


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _valid(name: str) -> bool:
    return 2 <= len(name) <= 100 and not re.search(GENERIC_NAME, name) and bool(re.search("[A-Za-zÀ-ÿ]", name))


def _prices(text: str) -> list[tuple[float, str, str | None]]:
    found = []
    for m in re.finditer(extract.PRICE, text):
        amount = float(re.search(r"\d{1,4}(?:[.,]\d{1,2})?", m[0])[0].replace(",", "."))
        if 0 < amount <= 100_000:
            found.append((amount, m[0], "from" if re.match(r"(?i)(?:desde|from)\b", m[0]) else None))
    return found


def _explicit(e: Element) -> bool:
    near = [e, e.parent] if e.parent else [e]
    return any(re.search(EXPLICIT_ITEM, f"{x.get('class')} {x.get('id')}") for x in near) or e.get("itemprop") == "name" or bool(re.search(ITEM_TYPE, e.get("itemtype")))


def _wanted(e: Element) -> bool:
    return e.tag in ("li", "tr", "article") or e.tag == "div" and _explicit(e)


def _context(e: Element) -> str:
    near = [x for x, _ in zip(e.up(), range(4), strict=False)]
    return _clean(" ".join(f"{x.get('class')} {x.get('id')} {x.get('aria-label')} {x.before}" for x in near))


def markup_item(e: Element, base: str) -> tuple | None:
    """The fields of ``ITEM`` of an element, if it is an item."""
    context = _context(e)
    if any(x.tag in ASIDE for x in e.up() if x is not e) or not re.search(CONTEXT, context):
        return None
    text = _clean(" ".join(e.text))
    if not text or len(text) > ELEMENT_CHARS or re.search(extract.HOURS, text):
        return None
    prices = _prices(text)
    if len(prices) > 1:
        return None
    named = e.attributes.get("data-name") or next((" ".join(e.named[t]) for t in NAMED if t in e.named), "") or text
    name = _clean(named.replace(prices[0][1], "", 1) if prices else named)
    name = re.sub(EDGES, "", name).strip()[:120]
    if not _valid(name):
        return None
    if not prices and (re.search(DESCRIPTIVE, name) or not _explicit(e) or len(text) > 100 or re.search(r"[.!?].+[.!?]", text)):
        return None
    kind = "specialty" if re.search(SPECIALTY_CONTEXT, context) else "service" if re.search(SERVICE_CONTEXT, context) else "product"
    amount, raw, qualifier = prices[0] if prices else (None, None, None)
    try:
        url = urljoin(base, e.links[0]) if e.links and e.links[0] else None
    except ValueError:
        url = None
    return name, kind, amount, raw, qualifier, url


def markup_items(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, the columns of ``ITEM``) of pages (key, url, html), in document order; a null page has none."""
    kind = pa.schema([("pos", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("amount", pa.float64()), ("raw", pa.string()), ("qualifier", pa.string()), ("url", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, pages_ = batch.columns
            at, rows = [], []
            for k in range(batch.num_rows):
                found = [markup_item(e, urls[k].as_py() or "") for e in elements(pages_[k].as_py() or "", _wanted, NAMED)]
                for pos, item in enumerate(x for x in found if x):
                    at.append(k)
                    rows.append((pos, *item))
            columns = zip(*rows, strict=True) if rows else [()] * len(kind)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), *[pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)]], [key, *kind.names])

    return pages.select(key, "url", "html").mapInArrow(run, StructType([pages.schema[key], *StructType.fromDDL(f"pos int, {ITEM}").fields]))


# ---- structured data


def scripts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, script, format, json) of the JSON scripts of pages, those of ``SCRIPT_CHARS`` and less."""
    one = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*>.*?</script>"), 0), lambda s: F.struct(F.regexp_extract(s, r"(?is)^<script\b([^>]*)>", 1).alias("a"), F.regexp_extract(s, r"(?is)^<script\b[^>]*>(.*)</script>$", 1).alias("body")))
    rows = pages.select(key, F.posexplode(one).alias("script", "s"))
    kind = F.when(F.col("s.a").rlike(r"""(?i)type=["']application/ld\+json["']"""), "json-ld").when(F.col("s.a").rlike(r"""(?i)type=["']application/json["']"""), "embedded-json")
    return rows.select(key, "script", kind.alias("format"), F.col("s.body").alias("body")).where(F.col("format").isNotNull() & (F.length("body") <= SCRIPT_CHARS)).select(key, "script", "format", decode_entities(F.col("body")).alias("json"))


def _m(name: str, part: str = "text") -> Column:
    return F.try_element_at("members", F.lit(name))[part]


def _string(name: str) -> Column:
    return F.when(_m(name, "kind") == "string", _m(name))


def same_identity(a: Column, b: Column) -> Column:
    """Two folded names are one, or one of six letters or more is part of the other."""
    return (a == b) | ((F.length(a) >= 6) & F.contains(b, a)) | ((F.length(b) >= 6) & F.contains(a, b))


def structured(pages: DataFrame, key: str = "page_id", expected: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, hours, guards) of the structured data of pages (key, url, html).

    items: (key, script, seq, columns of ``ITEM``, format); hours: (key, script, path, value,
    format); guards: (key, several, target) of pages with a business, several being true if
    they name more than one, and target the (script, path) of the one whose name, of those,
    alone agrees with the column ``expected``. ``script``, ``seq`` and ``path`` tell the place.
    """
    extra = [key, "url"] + ([expected] if expected else [])
    read = scripts(pages, key).join(pages.select(*extra), key) if expected else scripts(pages, key).join(pages.select(key, "url"), key)
    nodes = json_walk(read, "json").where("path is not null")
    name = _string("name")
    business = F.arrays_overlap("types", F.array(*[F.lit(t) for t in BUSINESS_TYPES])) & name.isNotNull()
    nodes = nodes.withColumn("business", F.when(business, F.struct(fold(name).alias("name"), "script", "seq", "path")))
    of_page = Window.partitionBy(key)
    # The last business of each name stands for it.
    nodes = nodes.withColumn("businesses", F.array_sort(F.transform(F.collect_list("business").over(of_page), lambda b: F.struct(b["script"].alias("script"), b["seq"].alias("seq"), b["name"].alias("name"), b["path"].alias("path")))))
    names = F.array_distinct(F.transform("businesses", lambda b: b["name"]))
    nodes = nodes.withColumn("several", F.size(names) > 1)
    wanted = fold(F.col(expected)) if expected else F.lit(None).cast("string")
    fitting = once(F.filter(names, lambda n: F.coalesce(same_identity(n, wanted), F.lit(False))), lambda x: F.when(F.size(x) == 1, x[0]))
    nodes = nodes.withColumn("fitting", fitting)
    target = F.when(F.col("several"), F.element_at(F.concat(F.array(F.lit(None).cast("struct<script:int,seq:int,name:string,path:string>")), F.filter("businesses", lambda b: b["name"] == F.col("fitting"))), -1))
    nodes = nodes.withColumn("target", target).drop("businesses", "business", "fitting")
    inside = (F.col("script") == F.col("target.script")) & ((F.col("path") == F.col("target.path")) | (F.col("target.path") == "") | F.startswith("path", F.concat("target.path", F.lit("."))) | F.startswith("path", F.concat("target.path", F.lit("["))))
    format_ = F.when(F.col("several"), "json-ld").otherwise(F.col("format"))
    guards = nodes.groupBy(key).agg(F.first("several").alias("several"), F.first(F.struct(F.col("target.script").alias("script"), F.col("target.path").alias("path"))).alias("target"))
    nodes = nodes.where(~F.col("several") | F.coalesce(inside, F.lit(False)))

    has = lambda *types: F.arrays_overlap("types", F.array(*[F.lit(t) for t in types]))
    days = F.transform(F.coalesce(_m("dayOfWeek", "texts"), F.when(_m("dayOfWeek", "kind") == "string", F.array(_m("dayOfWeek")))), lambda d: F.substring_index(d, "/", -1))
    hours = nodes.where(has("OpeningHoursSpecification") & (F.size(days) > 0) & _string("opens").isNotNull() & _string("closes").isNotNull())
    hours = hours.select(key, "script", "path", F.concat(F.array_join(days, ", "), F.lit(": "), _m("opens"), F.lit("-"), _m("closes")).alias("value"), format_.alias("format"))

    own = F.struct("seq", F.col("types"), name.alias("name"), F.coalesce(_m("price", "kind"), F.lit("")).alias("price"), F.coalesce(_m("offers", "kind"), F.lit("")).alias("offers"), _string("url").alias("url"), format_.alias("format"), F.col("url").alias("page"))
    offer = F.struct(F.coalesce("pos", F.lit(-1)).alias("pos"), F.when(_m("price", "kind").isin("number", "string"), _m("price")).alias("price"), _string("priceCurrency").alias("currency"), _string("url").alias("url"))
    is_offer = F.col("path").rlike(r"(^|\.)offers(\[\d+\])?$") & F.col("parent").isNotNull()
    role = F.array_compact(F.array(F.struct(F.col("path").alias("owner"), own.alias("own"), offer.alias("self"), F.lit(None).cast("struct<pos:int,price:string,currency:string,url:string>").alias("offer")), F.when(is_offer, F.struct(F.col("parent").alias("owner"), F.lit(None).alias("own"), F.lit(None).alias("self"), offer.alias("offer")))))
    found = nodes.select(key, "script", F.explode(role).alias("r")).groupBy(key, "script", F.col("r.owner").alias("path")).agg(F.max("r.own").alias("own"), F.max("r.self").alias("self"), F.min("r.offer").alias("offer"))
    embedded = F.col("own.name").isNotNull() & ((F.col("own.price") != "") | (F.col("own.offers") == "object"))
    is_a = lambda *types: F.arrays_overlap("own.types", F.array(*[F.lit(t) for t in types]))
    kind = F.when(is_a("Service"), "service").when(is_a("MenuItem", "Product") | embedded, "product")
    found = found.withColumn("name", clean_name(F.col("own.name"))).where((is_a(*COMMERCIAL_TYPES) | embedded) & kind.isNotNull() & F.col("own.name").isNotNull() & valid_name(F.col("name")))
    found = found.withColumn("offer", F.coalesce("offer", F.when(is_a("Offer"), F.col("self"))))
    amount = F.replace("offer.price", F.lit(","), F.lit(".")).try_cast("double")
    priced = (F.upper("offer.currency") == "EUR") & (amount > 0) & (amount <= 100_000)
    web = lambda u: F.when(u.rlike("(?i)^https?://"), u)
    items = found.select(
        key, "script", F.col("own.seq").alias("seq"), "name", kind.alias("kind"), F.when(priced, amount).alias("amount"), F.when(priced, F.concat("offer.price", F.lit(" EUR"))).alias("raw"), F.lit(None).cast("string").alias("qualifier"),
        F.coalesce(web(F.col("own.url")), web(F.col("offer.url")), web(F.col("own.page"))).alias("url"), F.col("own.format").alias("format"),
    )
    return items, hours, guards


# ---- plain lines


def text_items(texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, pos, columns of ``ITEM``) of the lines of texts that have one price and come after a heading."""
    lines = F.filter(F.transform(F.split(F.col(column), r"\n|\s{3,}"), lambda x: F.trim(F.regexp_replace(decode_entities(x), r"\s+", " "))), lambda x: (x != "") & (F.length(x) <= LINE_CHARS))
    rows = texts.select(key, F.posexplode(lines).alias("pos", "line"))
    heading = F.regexp_extract("line", HEADING, 0)
    kind = F.when(F.trim(heading) == "", None).when(heading.rlike(SPECIALTY_CONTEXT), "specialty").when(heading.rlike(SERVICE_CONTEXT), "service").otherwise("product")
    rows = rows.select(key, "pos", F.trim(F.regexp_replace("line", HEADING, "")).alias("line"), kind.alias("kind"))
    rows = rows.withColumn("kind", F.last("kind", ignorenulls=True).over(Window.partitionBy(key).orderBy("pos")))
    rows = rows.withColumn("prices", extract.prices(F.col("line"))).where((F.size("prices") == 1) & F.col("kind").isNotNull())
    price = F.get("prices", F.lit(0))
    name = clean_name(F.replace("line", price["raw"], F.lit("")))
    rows = rows.select(key, "pos", name.alias("name"), "kind", price["amount"].alias("amount"), price["raw"].alias("raw"), F.when(price["from"], "from").alias("qualifier"), F.lit(None).cast("string").alias("url"))
    return rows.where(valid_name(F.col("name")))


# ---- together


def commercial(pages: DataFrame, key: str = "page_id", expected: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, hours, summary) of pages (key, url, html).

    Of items of one kind and folded name the best format stays, of these one with a price,
    then the first; a page has ``ITEMS`` at most, the first ones. Markup of a page that names
    several businesses is nobody's. The summary has a row for every page, counts filled with
    zeros by format and dimension, and the reasons for what was left out.
    """
    made, hours, guards = structured(pages, key, expected)
    plain = markup_items(pages, key).join(guards.where("several").select(key), key, "left_anti")
    order = F.struct(F.col("script"), F.col("seq"))
    columns = [key, "name", "kind", "amount", "raw", "qualifier", "url", "format"]
    rows = made.select(*columns, order.alias("order")).unionByName(plain.select(key, "name", "kind", "amount", "raw", "qualifier", "url", F.lit("html").alias("format"), F.struct(F.lit(1 << 30).alias("script"), F.col("pos").alias("seq")).alias("order")))
    rank = F.array_position(F.array(*[F.lit(f) for f in FORMATS]), F.col("format"))
    value = F.struct("name", "amount", "raw", "qualifier", "url", "format")
    best = F.min_by(value, F.struct((-rank).alias("r"), F.col("amount").isNull().alias("n"), F.col("order").alias("o")))
    items = rows.groupBy(key, "kind", fold(F.col("name")).alias("folded")).agg(best.alias("v"), F.min("order").alias("order"))
    items = items.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("order", "kind", "folded")))
    over = items.groupBy(key).agg(F.greatest(F.count("*") - ITEMS, F.lit(0)).alias("over"))
    items = items.where(F.col("nth") <= ITEMS).select(key, F.col("nth").alias("pos"), "kind", "v.*")
    # Hours of a page's text come after those of its data.
    text = pages.select(key, F.explode(extract.opening_hours(html_to_text(F.col("html")))).alias("value")).select(key, "value", F.lit("html").alias("format")).join(guards.where("several").select(key), key, "left_anti")
    hours = hours.select(key, "value", "format").unionByName(text)
    hours = hours.groupBy(key, fold(F.col("value")).alias("folded")).agg(F.min_by(F.struct("value", "format"), F.struct((-F.array_position(F.array(*[F.lit(f) for f in FORMATS]), F.col("format"))).alias("r"), F.col("value").alias("v"))).alias("h")).select(key, "h.*")
    return items, hours, summary(pages, items, hours, guards, over, key)


def summary(pages: DataFrame, items: DataFrame, hours: DataFrame, guards: DataFrame, over: DataFrame, key: str = "page_id") -> DataFrame:
    """A row for each page: items by format and by dimension, with zeros, and reasons for what was discarded."""
    n = lambda c, name: F.count_if(c).alias(name)
    counts = items.groupBy(key).agg(*[n(F.col("format") == f, f.replace("-", "_")) for f in FORMATS], *[n(F.col("kind") == k, d) for k, d in (("product", "products"), ("service", "services"), ("specialty", "specialties"))], n(F.col("amount").isNotNull(), "prices"))
    open_ = hours.groupBy(key).agg(F.count("*").alias("opening_hours"))
    rows = pages.select(key).join(counts, key, "left").join(open_, key, "left").join(guards, key, "left").join(over, key, "left")
    reasons = F.array_compact(F.array(F.when(F.col("several") & F.col("target.path").isNull(), "ambiguous-structured-data"), F.when(F.col("several"), "markup-of-several-businesses"), F.when(F.col("over") > 0, F.concat(F.lit("over-limit:"), "over"))))
    names = [*[f.replace("-", "_") for f in FORMATS], "products", "services", "specialties", "prices", "opening_hours"]
    return rows.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in names], reasons.alias("discarded"))

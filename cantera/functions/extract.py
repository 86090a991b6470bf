"""What texts say, as column expressions: prices, hours, vocabularies, lists, units, quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cantera.functions.text import fold, once, strip_marks

# The patterns of prices and opening hours, in Spanish and English.
PRICE = r"(?i)(?:(?:desde|from)\s+)?(?:€\s*\d{1,4}(?:[.,]\d{1,2})?|\d{1,4}(?:[.,]\d{1,2})?\s*(?:€|EUR\b))"
DAY = r"(?:lunes|martes|mi[eé]rcoles|jueves|viernes|s[aá]bado|domingo|monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
HOURS = rf"(?i)\b{DAY}(?:\s*(?:a|to|-|–|,|y)\s*{DAY})?\s*[:\-]?\s*(?:de\s*)?\d{{1,2}}[:.]\d{{2}}\s*(?:a|-|–)\s*\d{{1,2}}[:.]\d{{2}}\b"
# Words that say nothing about a claim.
STOP_WORDS = ("para", "como", "esta", "este", "tiene", "cuenta", "segun", "desde", "entre", "sobre", "restaurante", "elige", "buscas", "publica")
# Units of a price, and the condition that isn't one.
UNITS = (
    ("per-person", r"(?i)\b(?:por|cada|/)\s*(?:persona|pers\.?|comensal)\b|\bp\.\s?p\.?(?:\s|$|[;,)])|\bpax\b|\bper\s+person\b|\bpp\b"),
    ("per-portion", r"(?i)\b(?:media\s+)?raci[oó]n\b|\bper\s+portion\b"),
    ("per-unit", r"(?i)\b(?:por|cada|la|el)\s+unidad\b|\bunidad\b|\bud\.|\b/\s*ud\b|\beach\b|\bper\s+(?:unit|piece)\b"),
)
AT_LEAST = r"(?i)\bm[ií]n(?:imo|\.)?\s*(?:de\s+)?\d+\s*(?:personas?|pax|comensales)\b"
# Words by which a text says that something couldn't be found out.
UNVERIFIED = (
    r"(?i)\bno\s+(?:se\s+)?(?:publica|publican|indica|indican|consta|constan|especifica|especifican|detalla|detallan|aclara|aclaran|muestra|muestran|figura|figuran|encontramos|hemos\s+podido|pudimos|confirma|confirman)\b"
    r"|\bsin\s+(?:precios?|horarios?|datos|informaci[oó]n|confirmar|publicar|indicar|detallar)\b|\ben\s+actualizaci[oó]n\b|\bcontradic|\bconflict|\bdesconoc|\bno\s+est[aá]\s+claro\b|\bpendiente\s+de\s+(?:confirmar|verificar)\b"
)


def prices(text: Column) -> Column:
    """(raw, amount, from) of the prices in euro above 0 and up to 100,000, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PRICE), 0), lambda m: F.struct(m.alias("raw"), F.replace(F.regexp_extract(m, r"(\d{1,4}(?:[.,]\d{1,2})?)", 1), F.lit(","), F.lit(".")).cast("double").alias("amount"), m.rlike(r"(?i)^(?:desde|from)\b").alias("from")))
    return F.filter(found, lambda p: (p["amount"] > 0) & (p["amount"] <= 100_000))


def opening_hours(text: Column) -> Column:
    """Days with a range of hours, as they stand but for surplus space."""
    return F.transform(F.regexp_extract_all(text, F.lit(HOURS), 0), lambda m: F.trim(F.regexp_replace(m, r"\s+", " ")))


def vocabulary(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Labels of the patterns that match, in the order of the list."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), label) for p, label in patterns]))


def yes_or_no(text: Column, yes: str, no: str) -> Column:
    """False if the text denies, else true if it affirms, else null."""
    return F.when(text.rlike(no), False).when(text.rlike(yes), True)


def labelled_list(text: Column, label: str) -> Column:
    """Up to eight items of 3 to 80 characters in the 240 characters after a label."""
    after = F.substring(F.regexp_extract(text, rf"(?s)(?:{label})(.*)", 1), 1, 240)
    items = F.filter(F.transform(F.split(after, r"[|•·;,.]"), lambda x: F.trim(x)), lambda x: F.length(x).between(3, 80))
    return F.when(text.rlike(label), F.slice(items, 1, 8)).otherwise(F.slice(items, 1, 0))


def singular(word: Column) -> Column:
    n = F.length(word)
    return F.when((n > 5) & F.endswith(word, F.lit("es")), F.substr(word, F.lit(1), n - 2)).when((n > 4) & F.endswith(word, F.lit("s")), F.substr(word, F.lit(1), n - 1)).otherwise(word)


def claim_tokens(text: Column) -> Column:
    """Folded words of four letters or more, or numbers, without stop words, singular; in order, with repeats."""
    words = F.split(F.regexp_replace(fold(text), r"\bdiari[oa]s?\b", "dias"), " ")
    return F.transform(F.filter(words, lambda w: ((F.length(w) >= 4) | w.rlike(r"^\d+$")) & ~w.isin(*STOP_WORDS)), singular)


def long_words(text: Column) -> Column:
    """Distinct folded words of four letters or more that aren't stop words."""
    return F.array_distinct(F.filter(F.split(fold(text), " "), lambda w: (F.length(w) >= 4) & ~w.isin(*STOP_WORDS)))


def support_parts(text: Column, category: Column) -> Column:
    """What ``supports`` needs of a text: its tokens, whether it asks for prices or for hours, and whether it has hours."""
    price = (category == "prices") & text.rlike(r"(?i)\bprecios?\b")
    asks = (category == "practical") & text.rlike(r"(?i)\b(?:horario|abre|apertura|cierra|mediod[ií]a|noche|d[ií]as?)\b")
    return F.struct(F.array_distinct(claim_tokens(text)).alias("tokens"), F.coalesce(price, F.lit(False)).alias("price"), F.coalesce(asks, F.lit(False)).alias("asks"), F.coalesce(text.rlike(r"\d{1,2}:\d{2}"), F.lit(False)).alias("hours"))


def supports(fact: Column, claim: Column) -> Column:
    """Whether a fact's text backs a claim: a shared token, or the words of prices and of hours; both are ``support_parts``, made once a text."""
    return claim["price"] | (claim["asks"] & fact["hours"]) | F.coalesce(F.arrays_overlap(fact["tokens"], claim["tokens"]), F.lit(False))


def stem_match(words: Column, needle: Column) -> Column:
    """Whether a word equals the needle or starts with its first five letters (four at least)."""
    stem = F.substring(needle, 1, 5)
    return F.exists(words, lambda w: (w == needle) | ((F.length(stem) >= 4) & F.startswith(w, stem)))


def sentences(text: Column) -> Column:
    """Sentences of three words or more."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: F.size(F.filter(F.split(fold(x), " "), lambda w: w != "")) >= 3)


def density(text: Column, needles: Column) -> Column:
    """Share of sentences that have one of the words, by stem; 0 without sentences."""
    return once(sentences(text), lambda all_: density_of(all_, needles))


def density_of(all_: Column, needles: Column) -> Column:
    """``density`` of sentences that are known; each is folded once, whatever the number of words."""
    hit = F.filter(all_, lambda s: once(F.split(fold(s), " "), lambda words: F.exists(needles, lambda n: stem_match(words, n))))
    return F.when(F.size(all_) > 0, F.size(hit) / F.size(all_)).otherwise(0.0)


def without_repeats(text: Column, others: Column) -> Column:
    """The parts of a text that don't share half their long words with one of the others; the text itself if under 40 characters are left."""

    def long_words(x: Column) -> Column:
        return F.array_distinct(F.filter(F.split(fold(x), " "), lambda w: F.length(w) >= 4))

    def repeated(part: Column) -> Column:
        return F.exists(others, lambda o: F.coalesce(F.size(F.array_intersect(long_words(part), long_words(o))) / F.nullif(F.least(F.size(long_words(part)), F.size(long_words(o))), F.lit(0)) >= 0.5, F.lit(False)))

    parts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^,.!?;]+[,.!?;]?"), 0), lambda p: F.trim(p)), lambda p: p != "")
    kept = F.trim(F.regexp_replace(F.array_join(F.filter(parts, lambda p: ~repeated(p)), " "), r"[,;]\s*$", "."))
    return once(kept, lambda k: F.when((F.size(others) > 0) & (F.length(k) >= 40), k).otherwise(text))


def excerpt(text: Column, term: Column, size: int = 280) -> Column:
    """The first sentence or line that has a folded term, cut to size; null without one."""
    found = F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda x: F.contains(fold(x), fold(term)))
    return F.substring(F.trim(F.get(found, F.lit(0))), 1, size)


def price_unit(qualifier: Column) -> Column:
    """The one unit that a text names; ambiguous if it names none or several."""
    bare = F.regexp_replace(qualifier, AT_LEAST, " ")
    found = F.array_compact(F.array(*[F.when(bare.rlike(p), unit) for unit, p in UNITS]))
    return F.when(F.size(found) == 1, found[0]).otherwise("ambiguous")


def limitation(text: Column, backed: Column) -> Column:
    """unverified if the text says that something is missing or unclear, or nothing backs it; else condition."""
    return F.when(text.rlike(UNVERIFIED) | ~F.coalesce(backed, F.lit(False)), "unverified").otherwise("condition")


def without_hours(text: Column) -> Column:
    """A text without ranges of exact hours."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)\s+(?:de\s+)?\d{1,2}:\d{2}\s*(?:a|[–-])\s*\d{1,2}:\d{2}", ""), r"\s{2,}", " "))


def quoted_number(value: Column, quote: Column) -> Column:
    """Whether a quote has a number as it stands or with two decimals, with a point or a comma, and no digits around it."""
    forms = F.array(F.format_string("%.2f", value), F.regexp_replace(value.cast("string"), r"\.0$", ""))
    either = F.array_join(F.transform(forms, lambda x: F.replace(x, F.lit("."), F.lit("[.,]"))), "|")
    return F.regexp_like(quote, F.concat(F.lit(r"(^|[^\d.,])("), either, F.lit(r")($|[^\d.,]|[.,]($|\D))")))


def quoted_hours(value: Column, quote: Column) -> Column:
    """Whether a quote has every hour of a range, with or without a leading zero."""
    return F.forall(F.split(value, "-"), lambda h: F.regexp_like(quote, F.concat(F.lit(r"(^|\D)("), h, F.lit("|"), F.regexp_replace(h, r"^0(\d)", "$1"), F.lit(r")($|\D)"))))


def unique_folded(values: Column, most: int = 20) -> Column:
    """Values that differ beyond case, marks and space; the first of each, ``most`` at most."""
    key = lambda v: F.trim(F.regexp_replace(F.lower(strip_marks(v)), r"\s+", " "))
    pairs = F.transform(values, lambda v, k: F.struct(key(v).alias("key"), v.alias("value"), k.alias("k")))
    first = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["key"] == p["key"]) & (q["k"] < p["k"])))
    return F.slice(F.transform(first, lambda p: p["value"]), 1, most)


def merge_lists(old: Column, new: Column) -> Column:
    """A list fact with further values, of 160 characters at most and two at least, each once."""
    clean = F.filter(F.transform(F.array_compact(new), lambda v: F.substring(F.trim(F.regexp_replace(v, r"\s+", " ")), 1, 160)), lambda v: F.length(v) >= 2)
    return F.when(F.size(clean) > 0, unique_folded(F.concat(F.coalesce(old, F.slice(clean, 1, 0)), clean))).otherwise(old)


def joined(values: Column) -> Column:
    """A list as Spanish prose: commas, and ``y`` before the last (``e`` before an i)."""
    n = F.size(values)
    last = F.element_at(values, -1)
    word = F.when(last.rlike(r"(?i)^h?i(?!e)"), " e ").otherwise(" y ")
    return F.when(n == 0, "").when(n == 1, values[0]).otherwise(F.concat(F.array_join(F.slice(values, 1, F.greatest(n - 1, F.lit(1))), ", "), word, last))


def tag_list(value: Column) -> Column:
    """The values of a tag, split at semicolons and commas."""
    return F.filter(F.transform(F.split(F.regexp_replace(value, "_", " "), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def tag_boolean(value: Column) -> Column:
    """yes, true and only are true, no and false are false, anything else isn't known."""
    return F.when(F.lower(value).isin("yes", "true", "only"), True).when(F.lower(value).isin("no", "false"), False)

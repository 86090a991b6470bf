"""Text functions as column expressions."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _base(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F)


@lru_cache(maxsize=1)
def _letters() -> tuple[str, str]:
    """Characters whose compatibility form is one ASCII letter or digit and marks, and that form."""
    src, dst = [], []
    for c in map(chr, range(128, 0x20000)):
        base = _base(c)
        if len(base) == 1 and base.isascii() and base.isalnum():
            src.append(c)
            dst.append(base)
    return "".join(src), "".join(dst)


@lru_cache(maxsize=1)
def _ligatures() -> tuple[str, str]:
    """A class of the characters whose compatibility form is several, with ASCII letters or digits, and a JSON object of their forms."""
    forms = {c: base for c in map(chr, range(128, 0x20000)) if len(base := _base(c)) > 1 and any(x.isascii() and x.isalnum() for x in base)}
    ranges: list[list[int]] = []
    for o in sorted(map(ord, forms)):
        if ranges and ranges[-1][1] == o - 1:
            ranges[-1][1] = o
        else:
            ranges.append([o, o])
    return "[" + "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in ranges) + "]", json.dumps(forms, ensure_ascii=False)


def strip_marks(text: Column) -> Column:
    """Letters without their marks, composed or not, and compatibility forms as what they stand for; ASCII texts as they are.

    A character that stands for several (a ligature, a fraction, a unit) is replaced once
    for each that a text has; texts without any pay for one test.
    """
    pattern, forms = _ligatures()
    known = F.from_json(F.lit(forms), "map<string,string>")
    spelled = F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0)), text, lambda out, c: F.replace(out, c, known[c]))
    bare = lambda t: F.translate(F.regexp_replace(t, r"[\u0300-\u036f]", ""), *_letters())
    return F.when(~text.rlike(r"[^\x00-\x7F]"), text).when(text.rlike(pattern), bare(spelled)).otherwise(bare(text))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def fold(text: Column) -> Column:
    """Lower-case words of a-z and 0-9 of the compatibility decomposition, one space between them."""
    return F.trim(F.regexp_replace(F.lower(strip_marks(text)), "[^a-z0-9]+", " "))


def slugify(text: Column, default: str = "sin-nombre") -> Column:
    s = F.replace(fold(text), F.lit(" "), F.lit("-"))
    return F.when(F.coalesce(s, F.lit("")) == "", default).otherwise(s)


def contains_phrase(folded: Column, phrase: Column) -> Column:
    """Whole-word match of a folded phrase; an empty phrase matches nothing."""
    return (F.length(phrase) > 0) & F.contains(F.concat(F.lit(" "), folded, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def tokens(text: Column, least: int = 4) -> Column:
    """Distinct folded words of at least ``least`` letters, or with a digit."""
    return F.array_distinct(F.filter(F.split(fold(text), " "), lambda w: (F.length(w) >= least) | w.rlike("[0-9]")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def decode_entities(text: Column) -> Column:
    """Six named entities and numeric ones as characters; others stay."""

    def numeric(part: Column) -> Column:
        code = F.when(part.rlike("^[xX]"), F.conv(F.regexp_extract(part, r"^[xX]([0-9a-fA-F]{1,6});", 1), 16, 10)).otherwise(F.regexp_extract(part, r"^(\d{1,7});", 1)).try_cast("int")

        def char(n: Column) -> Column:
            known = part.rlike(r"^(\d{1,7}|[xX][0-9a-fA-F]{1,6});") & n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
            one = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
            return F.when(known, F.concat(one, F.regexp_replace(part, r"^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), part))

        return once(code, char)

    def plain(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), numeric), ""))

    def named(x: Column) -> Column:
        # The named entities that are decoded; the ampersand comes last.
        for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            x = F.replace(x, F.lit(name), F.lit(char))
        return x

    return once(text, lambda x: F.when(F.contains(x, F.lit("&")), named(once(F.split(x, "&#"), plain))).otherwise(x))


def html_to_text(html: Column) -> Column:
    """Visible text: no scripts, styles or comments; tags to spaces; entities decoded."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    text = decode_entities(F.regexp_replace(text, r"(?s)<[^>]*>", " "))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))

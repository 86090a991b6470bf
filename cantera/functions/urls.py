"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: parameters that only track visitors.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|ref)="


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """No fragment and no tracking parameters; the others sorted; host in lower case."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z]+)://", 1))
    return F.concat(scheme, F.lit("://"), host(url), path(url), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def source_key(url: Column) -> Column:
    """Names a page across scheme, ``www.``, language segment and trailing slash."""
    place = F.regexp_replace(path(url), r"^/(es|en|fr|de)(?=/|$)", "")
    return F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(place, r"/+$", ""))


def domains(h: Column) -> Column:
    """A host and the domains that it is a subdomain of, for an equi-join with a list of allowed ones."""
    parts = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))

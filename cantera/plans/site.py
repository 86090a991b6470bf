"""Queries of the site audit, over all pages and a small site that breaks every rule once."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cantera.operators import audit, links
from cantera.sources.store import stored

from .registry import query


def _signals(**other) -> str:
    base = {"kind": "ficha", "storedNoIndex": False, "demo": False, "hasAddress": True, "titleIsFallback": False, "subject": "Café Sol", "h1": "", "contributions": ["own-photo"]}
    base["evidence"] = {"officialFact": True, "ownObservation": False, "creatorObservations": []}
    return json.dumps(base | other, ensure_ascii=False)


def _page(title="", head="", body="", signals=None) -> str:
    meta = f"<meta name='{audit.SIGNALS_META}' content='{signals}'>" if signals else ""
    return f"<html><head><title>{title}</title>{meta}{head}</head><body><nav><a href='/'>x</a></nav><main>{body}</main><footer><a href='/guias/uno/'>x</a></footer></body></html>"


SITE = "https://local.example.org"
CRUMBS = '<script type="application/ld+json">{"@graph": [{"@type": "BreadcrumbList"}]}</script>'
GOOD = CRUMBS + '<meta name="description" content="about">'
SEEN = {"officialFact": False, "ownObservation": False, "creatorObservations": [{"creator": "@ana", "url": "https://v.example/1", "publishedAt": "2026-01-05", "summary": " "}]}
# (path, html): one page or more for each rule.
PAGES = [
    ("/", _page("Inicio", GOOD + f'<link rel="canonical" href="{SITE}/">', "<h1>Inicio</h1><a href='/restaurantes/sol/'>a</a><a href=guias/uno/>b</a><a href='/nada/'>c</a><a href='/viejo/'>d</a>", _signals(kind="structural", subject="Inicio"))),
    ("/restaurantes/sol/", _page("Café Sol", GOOD + f'<link href="{SITE}/restaurantes/sol/" rel="x canonical">', "<h1>Cafe <b>sol</b></h1><img src=/a.jpg alt='' data-image-origin=propia><a href='/guias/uno/#x'>1</a><a href='../luna/'>2</a><a href='/f.pdf'>3</a>", _signals())),
    ("/restaurantes/luna/", _page("Café Luna", GOOD, "<h1>Otro</h1><h1>Más</h1><img src='/b.jpg'><img src='/c.jpg' alt='x' data-image-origin='stock' data-image-subject='business' data-image-license='CC0'><p>Menú 12,50 € verificada</p><a href='/restaurantes/sol/'>s</a>", _signals(subject="Luna", contributions=["creator-summary"], evidence=SEEN, hasAddress=False))),
    ("/guias/uno/", _page("Guía con un título que pasa de largo los sesenta caracteres que se permiten", '<meta content="noindex, follow" name="robots">', "<h2>Horario</h2><a href='/restaurantes/sol/'>s</a><a href='/restaurantes/luna/'>l</a>", _signals(kind="guide", subject="guía", demo=True, storedNoIndex=True, titleIsFallback=True))),
    ("/viejo/", _page("Viejo", '<meta http-equiv="refresh" content="0; url=/restaurantes/sol/">')),
    ("/404.html", _page("No está", "", "<h1>404</h1>")),
    ("/donde-comer/", _page("Igual", CRUMBS.replace("BreadcrumbList", "x").replace("]}", '], "review": 1}'), "<h1>Igual</h1><a href='/restaurantes/sol/'>s</a><a href='/donde-comer/cafes/'>c</a>")),
    ("/donde-comer/cafes/", _page("Igual", '<script type="application/ld+json">{broken</script>', "<h1>Igual</h1><p data-human-review>verificado, abierto 10:00 - 12:30</p><section aria-labelledby='sources-title'></section><a href='/restaurantes/sol/'>s</a><a href='/restaurantes/luna/'>s</a>", _signals(kind="structural", subject="igual"))),
    ("/vacio/", ""),
]
ROWS = [(-1 - k, SITE + p, h) for k, (p, h) in enumerate(PAGES)]


def _q(x: str) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if v is None else str(v) if isinstance(v, (int, float)) else _q(v) for v in r) + ')' for r in rows)}) AS v({names}))"


def _attr(tag: str, name: str) -> str:
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    return f"CASE WHEN regexp_matches({tag}, '(?is)\\s{name}\\s*=') THEN regexp_extract({tag}, '{pattern}', 1) || regexp_extract({tag}, '{pattern}', 2) || regexp_extract({tag}, '{pattern}', 3) WHEN regexp_matches({tag}, '(?is)\\s{name}[\\s/>]') THEN '' END"


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _decode(x: str) -> str:
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', {_q(char)})"
    return x


def _cut(x: str, *names: str) -> str:
    for n in names:
        x = rf"regexp_replace({x}, '(?is)<{n}\b[^>]*>.*?</{n}>', ' ', 'g')"
    return x


def _visible(x: str) -> str:
    return _collapse(_decode(rf"regexp_replace({_cut(x, 'script', 'style', 'template', 'noscript')}, '(?s)<[^>]*>', ' ', 'g')"))


def _target(href: str) -> str:
    h = f"trim({href})"
    bare = f"regexp_replace(regexp_replace({h}, '(?i)^(https?:)?//[^/?#]+', ''), '[?#].*$', '')"
    joined = f"CASE WHEN starts_with({bare}, '/') THEN {bare} WHEN {bare} = '' AND regexp_matches({h}, '(?i)^(https?:)?//') THEN '/' WHEN {bare} = '' THEN route WHEN starts_with({bare}, '../') THEN regexp_replace(route, '[^/]*/[^/]*$', '') || {bare}[4:] ELSE regexp_replace(route, '[^/]*$', '') || {bare} END"
    same = f"CASE WHEN regexp_matches({h}, '(?i)^https?://') THEN lower(regexp_extract({h}, '(?i)^(https?://[^/?#]+)', 1)) = scheme || '://' || host WHEN starts_with({h}, '//') THEN lower(regexp_extract({h}, '^//([^/?#]+)', 1)) = host ELSE NOT regexp_matches({h}, '(?i)^[a-z][a-z0-9+.-]*:') END"
    last = f"regexp_extract({joined}, '([^/]*)$', 1)"
    return f"CASE WHEN {h} = '' OR starts_with({h}, '#') OR NOT ({same}) THEN NULL WHEN contains({last}, '.') AND NOT ends_with({last}, '.html') THEN NULL WHEN {last} = '' OR ends_with({last}, '.html') THEN {joined} ELSE ({joined}) || '/' END"


def _first(items: str, test: str) -> str:
    return f"list_filter({items}, lambda m: {test})[1]"


PARSED = rf"""
WITH site AS (SELECT page_id, url, html FROM pages UNION ALL SELECT page_id, url, html FROM {_values(ROWS, "page_id, url, html")}),
s1 AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host,
  regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), 'index\.html$', '') AS p, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g') AS h FROM site),
s2 AS (SELECT page_id, scheme, host, h, CASE WHEN p = '' THEN '/' WHEN regexp_matches(p, '/$|\.[^/]*$') THEN p ELSE p || '/' END AS route, regexp_replace(h, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g') AS bare FROM s1),
s3 AS (SELECT *, regexp_extract_all(bare, '(?is)<meta\b[^>]*>') AS metas, regexp_extract_all(bare, '(?is)<link\b[^>]*>') AS heads, regexp_replace(bare, '(?is)<footer\b.*?</footer>', ' ', 'g') AS rest FROM s2),
s4 AS (SELECT *, {_first("metas", f"lower({_attr('m', 'http-equiv')}) = 'refresh'")} AS refresh, {_attr(_first("metas", f"lower({_attr('m', 'name')}) = 'robots'"), "content")} AS robots,
  {_attr(_first("metas", f"lower({_attr('m', 'name')}) = 'description'"), "content")} AS described, {_attr(_first("metas", f"{_attr('m', 'name')} = '{audit.SIGNALS_META}'"), "content")}::JSON AS sig,
  {_attr(_first("heads", f"list_contains(string_split_regex(lower({_attr('m', 'rel')}), '\\s+'), 'canonical')"), "href")} AS canonical FROM s3),
parsed AS (SELECT *, CASE WHEN refresh IS NOT NULL THEN 'redirect' WHEN route = '/404.html' THEN 'not-found' WHEN regexp_matches(coalesce(robots, ''), '(?i)\bnoindex\b') THEN 'noindex' ELSE 'indexable' END AS type,
  trim(regexp_extract({_attr("refresh", "content")}, '(?i)url\s*=\s*[''"]?([^''"]+)', 1)) AS redirect_to,
  nullif({_collapse(_decode(r"regexp_extract(bare, '(?is)<title\b[^>]*>(.*?)</title>', 1)"))}, '') AS title, nullif({_collapse("described")}, '') AS description,
  len(regexp_extract_all(bare, '(?is)<h1\b[^>]*>'))::BIGINT AS n_h1, nullif({_visible(r"regexp_extract(bare, '(?is)<h1\b[^>]*>(.*?)</h1>', 1)")}, '') AS h1,
  list_filter(list_concat(
    list_transform(list_filter(regexp_extract_all(array_to_string(regexp_extract_all(rest, '(?is)<header\b.*?</header>|<nav\b.*?</nav>'), ' '), '(?is)<a\b[^>]*>'), lambda a: {_attr("a", "href")} IS NOT NULL), lambda a: {{'href': {_attr("a", "href")}, 'zone': 'menu'}}),
    list_transform(list_filter(regexp_extract_all(regexp_replace(rest, '(?is)<header\b.*?</header>|<nav\b.*?</nav>', ' ', 'g'), '(?is)<a\b[^>]*>'), lambda a: {_attr("a", "href")} IS NOT NULL), lambda a: {{'href': {_attr("a", "href")}, 'zone': 'body'}}),
    list_transform(list_filter(regexp_extract_all(array_to_string(regexp_extract_all(bare, '(?is)<footer\b.*?</footer>'), ' '), '(?is)<a\b[^>]*>'), lambda a: {_attr("a", "href")} IS NOT NULL), lambda a: {{'href': {_attr("a", "href")}, 'zone': 'footer'}})), lambda x: true) AS hrefs,
  regexp_extract_all(bare, '(?is)<img\b[^>]*>') AS imgs, regexp_extract_all(h, '(?is)<script\b[^>]*type\s*=\s*["'']?application/ld\+json["'']?[^>]*>(.*?)</script>', 1) AS jsonld,
  regexp_matches(bare, '(?is)<[^>]*\sdata-human-review[\s=/>]') AS reviewed, regexp_matches(bare, '(?is)<[^>]*\sdata-seo-sources[\s=/>]|<section\b[^>]*\saria-labelledby\s*=\s*["'']?sources-title') AS sourced,
  coalesce(nullif(regexp_extract(bare, '(?is)<main\b[^>]*>(.*)</main>', 1), ''), nullif(regexp_extract(bare, '(?is)<body\b[^>]*>(.*)</body>', 1), ''), bare) AS main FROM s4),
li0 AS (SELECT page_id, scheme, host, route, type, unnest(hrefs) AS l FROM parsed),
li1 AS (SELECT DISTINCT page_id, host, route, type, l.zone AS zone, {_target("l.href")} AS target FROM li0),
known AS (SELECT host, target, arg_min({{'id': page_id, 'route': route, 'type': type, 'redirect_to': redirect_to}}, rank * 1000000000000 + page_id) AS p FROM (
  SELECT host, route AS target, 0 AS rank, page_id, route, type, redirect_to FROM parsed UNION ALL SELECT host, regexp_replace(route, '\.html$', '') || '/', 1, page_id, route, type, redirect_to FROM parsed WHERE ends_with(route, '.html')) GROUP BY 1, 2),
li AS (SELECT li1.*, p.id AS to_id, p.route AS to_route, p.type AS to_type, p.redirect_to AS to_redirect FROM li1 LEFT JOIN known k ON li1.host = k.host AND li1.target = k.target WHERE li1.target IS NOT NULL),
deg AS (SELECT q.page_id, count(DISTINCT l.route) AS incoming, count(DISTINCT CASE WHEN zone = 'body' THEN l.route END) AS contextual FROM parsed q
  LEFT JOIN li l ON l.to_id = q.page_id AND l.to_id <> l.page_id AND l.to_route <> l.route AND l.type IN ('indexable', 'noindex') GROUP BY 1)
"""
FOLDED = "lower(strip_accents(coalesce({0}, '')))"
OBS = "from_json(coalesce(sig->'evidence'->'creatorObservations', '[]'::JSON), '[{{\"creator\":\"VARCHAR\",\"url\":\"VARCHAR\",\"publishedAt\":\"VARCHAR\",\"summary\":\"VARCHAR\"}}]')".replace("{{", "{").replace("}}", "}")
ATTRIBUTED = r"(regexp_matches(trim(o.creator), '^@[\w.]+$') AND regexp_matches(trim(o.url), '^https://') AND regexp_matches(o.publishedAt, '^\d{4}-\d{2}-\d{2}') AND try_cast(o.publishedAt[1:10] AS DATE) IS NOT NULL)"
CHECKS = [
    ("stored-noindex", "(sig->>'storedNoIndex') = 'true'"),
    ("demo", "(sig->>'demo') = 'true'"),
    ("no-evidence", f"(sig->>'kind') <> 'structural' AND (sig->'evidence'->>'officialFact') <> 'true' AND (sig->'evidence'->>'ownObservation') <> 'true' AND len(list_filter(obs, lambda o: {ATTRIBUTED})) = 0"),
    ("no-address", "(sig->>'kind') = 'ficha' AND (sig->>'hasAddress') <> 'true'"),
    ("no-contribution", f"(sig->>'kind') <> 'structural' AND len(list_filter(from_json(sig->'contributions', '[\"VARCHAR\"]'), lambda c: c <> 'creator-summary' OR len(list_filter(obs, lambda o: {ATTRIBUTED} AND trim(o.summary) <> '')) > 0)) = 0"),
    ("few-links", "route <> '/' AND contextual < 2"),
    ("title-missing", "title IS NULL"),
    ("title-fallback", "title IS NOT NULL AND (sig->>'titleIsFallback') = 'true'"),
    ("title-subject", f"title IS NOT NULL AND (sig->>'titleIsFallback') <> 'true' AND NOT contains({FOLDED.format('title')}, {FOLDED.format('(sig->>$$subject$$)')})".replace("$$", "'")),
    ("h1-missing", "h1 IS NULL"),
    ("h1-subject", f"h1 IS NOT NULL AND NOT contains({FOLDED.format('h1')}, {FOLDED.format('(sig->>$$subject$$)')})".replace("$$", "'")),
]
WHY = f", obs AS (SELECT parsed.*, contextual, {OBS} AS obs FROM parsed JOIN deg USING (page_id)), why AS (SELECT *, CASE WHEN sig IS NOT NULL THEN list_filter([{', '.join(f'CASE WHEN {c} THEN {_q(k)} END' for k, c in CHECKS)}], lambda x: x IS NOT NULL) END AS why FROM obs WHERE type <> 'redirect')"


def _site(spark, t):
    extra = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    return audit.parse(t("pages").select("page_id", "url", "html").unionByName(extra))


def _parsed(spark, t):
    """The parse of all pages, written by a first pass; the queries that look at links and pages read it again."""
    return stored(_site(spark, t), "pages")


@query(
    PARSED
    + """SELECT page_id, host, route, type, redirect_to, title, description, canonical, n_h1, h1, len(imgs)::BIGINT AS n_images, len(jsonld)::BIGINT AS n_jsonld, reviewed, sourced,
  (SELECT count(*) FROM (SELECT 1 FROM li WHERE li.page_id = parsed.page_id))::BIGINT AS n_links FROM parsed"""
)
def page_parse(spark, t):
    n = F.size(F.array_distinct(F.col("links"))).cast("bigint")
    redirect = F.when(F.col("type") == "redirect", F.coalesce("redirect_to", F.lit("")))
    return _site(spark, t).select("page_id", "host", "route", "type", redirect.alias("redirect_to"), "title", "description", "canonical", "n_h1", "h1", F.size("images").cast("bigint").alias("n_images"), F.size("jsonld").cast("bigint").alias("n_jsonld"), "reviewed", "sourced", n.alias("n_links"))


@query(PARSED + "SELECT page_id, zone, target, to_id, to_route, to_type FROM li")
def internal_links(spark, t):
    return audit.resolved_links(_parsed(spark, t)).select("page_id", "zone", "target", "to_id", "to_route", "to_type")


@query(PARSED + "SELECT host, target, count(DISTINCT page_id) AS n_sources, count(*) AS n_links FROM (SELECT page_id, host, route, %s AS target FROM li0) WHERE target IS NOT NULL AND target <> route GROUP BY 1, 2" % _target("l.href"))
def link_graph(spark, t):
    each = _site(spark, t).select("page_id", "host", "route", F.explode("links.target").alias("target")).filter("target <> route")
    return each.groupBy("host", "target").agg(F.countDistinct("page_id").alias("n_sources"), F.count("*").alias("n_links"))


@query(PARSED + "SELECT page_id, incoming, contextual FROM deg")
def contextual_in_degree(spark, t):
    p = _parsed(spark, t)
    return audit.in_degrees(p, audit.resolved_links(p))


@query(PARSED + WHY + "SELECT page_id, array_to_string(why, ',') AS reasons, len(why) = 0 AS indexable FROM why WHERE why IS NOT NULL")
def indexability(spark, t):
    p = _parsed(spark, t)
    d = audit.in_degrees(p, audit.resolved_links(p))
    p = p.filter("signals is not null and type <> 'redirect'").join(d, "page_id")
    why = audit.reasons(F.col("signals"), F.col("route"), F.col("title"), F.col("h1"), F.col("contextual"))
    return p.select("page_id", F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("indexable"))


def _rule(rule: str, test: str, detail: str = "''", source: str = "why") -> str:
    return f"SELECT page_id, '{rule}' AS rule, CAST({detail} AS VARCHAR) AS detail FROM {source} WHERE {test}"


IMAGE = {a: _attr("m", f"data-image-{a}") for a in ("origin", "license", "author", "source", "subject")}
LACKS = "list_filter([" + ", ".join(f"CASE WHEN coalesce({IMAGE[a]}, '') = '' THEN '{a}' END" for a in ("license", "author", "source")) + "], lambda x: x IS NOT NULL)"
SRC = f"coalesce({_attr('m', 'src')}, '(sin src)')"
PRICED, TIMED = (rf"(regexp_matches({_visible('main')}, '\d+(?:[.,]\d{{1,2}})?\s?€|€\s?\d'))", rf"(regexp_matches({_visible('main')}, '\b\d{{1,2}}:\d{{2}}\s*[-–—]\s*\d{{1,2}}:\d{{2}}\b') OR regexp_matches(main, '(?is)<h[1-6]\b[^>]*>\s*horarios?\s*</h[1-6]>'))")
BLOCKS = rf"list_distinct(list_filter(list_transform(string_split_regex(regexp_replace({_cut('bare', 'style', 'template', 'noscript')}, '  ', ' ', 'g'), '<[^>]*>'), lambda x: {_collapse(_decode('x'))}), lambda x: regexp_matches(x, '(?i)\bverificadas?\b')))"
FINDINGS = " UNION ALL ".join(
    [
        _rule("orphan", "type = 'indexable' AND route <> '/' AND contextual < 2", "contextual"),
        _rule("indexability-mismatch", "type <> 'not-found' AND why IS NOT NULL AND (len(why) = 0) <> (type = 'indexable')", "array_to_string(why, ',')"),
        _rule("indexability-missing", "type = 'indexable' AND sig IS NULL", f"'{audit.SIGNALS_META}'"),
        _rule("h1-missing", "n_h1 = 0"),
        _rule("h1-multiple", "n_h1 > 1", "n_h1"),
        _rule("title-missing", "title IS NULL"),
        _rule("description-missing", "description IS NULL"),
        _rule("canonical-mismatch", "type = 'indexable' AND canonical IS DISTINCT FROM scheme || '://' || host || route", "coalesce(canonical, '')"),
        _rule("breadcrumb-missing", "type = 'indexable' AND route <> '/' AND len(list_filter(jsonld, lambda x: json_valid(x) AND regexp_matches(x, '\"@type\"\\s*:\\s*\"BreadcrumbList\"'))) = 0"),
        _rule("facts-without-sources", f"({PRICED} OR {TIMED}) AND NOT sourced", f"array_to_string(list_filter([CASE WHEN {PRICED} THEN 'prices' END, CASE WHEN {TIMED} THEN 'hours' END], lambda x: x IS NOT NULL), ',')"),
        _rule("title-too-long", "length(title) > 60", "length(title)"),
        _rule("image-no-own-photo", f"type = 'indexable' AND sig IS NOT NULL AND (sig->>'kind') <> 'structural' AND len(list_filter(imgs, lambda m: coalesce({IMAGE['origin']} = 'propia', false))) = 0"),
        f"SELECT page_id, 'unreviewed-verified', unnest({BLOCKS}) FROM why WHERE NOT reviewed",
        "SELECT page_id, 'jsonld-invalid', k || ': not JSON' FROM (SELECT page_id, generate_subscripts(jsonld, 1) AS k, unnest(jsonld) AS x FROM why) WHERE NOT json_valid(x)",
        "SELECT page_id, 'jsonld-invalid', k || ': ' || y FROM (SELECT page_id, k, unnest(list_distinct(regexp_extract_all(x, '\"(aggregateRating|review|reviews|reviewRating)\"\\s*:', 1))) AS y FROM (SELECT page_id, generate_subscripts(jsonld, 1) AS k, unnest(jsonld) AS x FROM why) WHERE json_valid(x))",
        f"SELECT DISTINCT page_id, 'image-origin-missing', {SRC} FROM (SELECT page_id, unnest(imgs) AS m FROM why) WHERE coalesce({IMAGE['origin']}, '') = ''",
        f"SELECT DISTINCT page_id, 'image-stock-incomplete', {SRC} || ': ' || array_to_string({LACKS}, ',') FROM (SELECT page_id, unnest(imgs) AS m FROM why) WHERE {IMAGE['origin']} = 'stock' AND len({LACKS}) > 0",
        f"SELECT DISTINCT page_id, 'image-stock-business', {SRC} FROM (SELECT page_id, unnest(imgs) AS m FROM why) WHERE {IMAGE['origin']} = 'stock' AND {IMAGE['subject']} = 'business'",
        f"SELECT DISTINCT page_id, 'img-missing-alt', {SRC} FROM (SELECT page_id, unnest(imgs) AS m FROM why) WHERE {_attr('m', 'alt')} IS NULL",
    ]
)


@query(PARSED + WHY + FINDINGS)
def page_audit(spark, t):
    p = _parsed(spark, t)
    return audit.page_findings(p, audit.in_degrees(p, audit.resolved_links(p)))


LINKED = "SELECT DISTINCT page_id, CASE WHEN to_id IS NULL THEN 'broken-link' ELSE 'link-to-redirect' END AS rule, zone, CASE WHEN to_id IS NULL THEN target ELSE target || ' ' || to_redirect END AS detail FROM li WHERE type <> 'redirect' AND (to_id IS NULL OR to_type = 'redirect')"


@query(PARSED + LINKED)
def link_findings(spark, t):
    return audit.link_findings(audit.resolved_links(_parsed(spark, t)))


@query(
    PARSED
    + ", ".join(["", *[f"d_{f} AS (SELECT page_id, '{f}-duplicate' AS rule, n || ' ' || array_to_string(list_filter(list_sort(first)[1:21], lambda r: r <> route)[1:20], ',') AS detail FROM (SELECT page_id, route, count(*) OVER w AS n, list(route) OVER w AS first FROM parsed WHERE type = 'indexable' AND {f} IS NOT NULL WINDOW w AS (PARTITION BY host, {f})) WHERE n > 1)" for f in ("title", "description")]])
    + " SELECT * FROM d_title UNION ALL SELECT * FROM d_description"
)
def duplicate_findings(spark, t):
    p = _parsed(spark, t)
    return audit.duplicate_findings(p, "title").unionByName(audit.duplicate_findings(p, "description"))


# The small site's sitemap: one route is no page, one is noindex and one redirects.
LISTED = [("local.example.org", r) for r in ("/", "/restaurantes/sol/", "/nada/", "/guias/uno/", "/viejo/", "/404.html")]


@query(
    PARSED
    + f""", listed AS (SELECT DISTINCT host, route FROM parsed WHERE scheme = 'https' AND page_id >= 0 UNION SELECT host, route FROM {_values(LISTED, "host, route")}),
u AS (SELECT host, route, arg_min(type, CASE type WHEN 'indexable' THEN 0 WHEN 'noindex' THEN 1 WHEN 'redirect' THEN 2 ELSE 3 END) AS type FROM parsed GROUP BY 1, 2)
SELECT l.host, l.route, 'sitemap-noindex' AS rule, coalesce(type, '404') AS detail FROM listed l LEFT JOIN u USING (host, route) WHERE coalesce(type, '') <> 'indexable'
UNION ALL SELECT host, route, 'sitemap-missing-indexable', type FROM u ANTI JOIN listed USING (host, route) WHERE type = 'indexable'"""
)
def sitemap_pages(spark, t):
    p = _parsed(spark, t)
    listed = p.filter("scheme = 'https' and page_id >= 0").select("host", "route").unionByName(spark.createDataFrame(LISTED, "host string, route string"))
    return audit.sitemap_findings(listed, p)


@query(
    PARSED
    + f""", f AS ({LINKED}), base AS (SELECT rule, zone, detail FROM f WHERE zone = 'menu') SELECT page_id, rule, zone, detail FROM f ANTI JOIN base USING (rule, zone, detail)"""
)
def findings_diff(spark, t):
    f = audit.link_findings(audit.resolved_links(_parsed(spark, t)))
    return audit.new_findings(f, f.filter("zone = 'menu'"), ["rule", "zone", "detail"])


# Routes of a graph: (route, type, outgoing, contextual links, reasons, zone).
GRAPH = [
    ("/", "indexable", "/donde-comer/", 0, None, None),
    ("/donde-comer/", "indexable", "/restaurantes/a/,/restaurantes/b/,/restaurantes/c/", 1, None, None),
    ("/donde-comer/cafes/", "indexable", "/restaurantes/a/", 1, None, None),
    ("/donde-comer/sin-enlaces/", "noindex", "/restaurantes/b/", 0, "few-links,links-unknown", None),
    ("/restaurantes/a/", "indexable", "/donde-comer/sin-enlaces/", 2, None, "centro"),
    ("/restaurantes/b/", "indexable", "/donde-comer/cafes/", 1, None, "centro"),
    ("/restaurantes/c/", "noindex", "", 0, "few-links", "playa"),
    ("/restaurantes/d/", "noindex", "/donde-comer/", 3, "demo,few-links", "centro"),
    ("/restaurantes/e/", "redirect", "", 0, None, "centro"),
    ("/restaurantes/f/", "indexable", "/donde-comer/,/restaurantes/a/", 5, None, ""),
    ("/guias/x/", "indexable", "/restaurantes/a/", 0, None, None),
]
# A page for each part, and a hub for each brand and size; pages of even size link to their hub, hubs to none.
PART_GRAPH = """SELECT '/restaurantes/p' || p_partkey || '/', CASE WHEN p_type = 'PROMO' THEN 'noindex' ELSE 'indexable' END, CASE WHEN p_size % 2 = 0 THEN '/donde-comer/' || replace(p_brand, '#', '-') || '-' || p_size || '/' ELSE '' END, p_size % 4, CASE WHEN p_type = 'PROMO' THEN CASE WHEN p_retailprice > 930 THEN 'demo' ELSE 'few-links' END END, p_brand || '/' || p_size FROM part
  UNION ALL SELECT DISTINCT '/donde-comer/' || replace(p_brand, '#', '-') || '-' || p_size || '/', 'indexable', '', 1, NULL, NULL FROM part"""
NODES = f"""
WITH g AS (SELECT route, type, string_split(outgoing, ',') AS outgoing, contextual, string_split(reasons, ',') AS reasons, nullif(zone, '') AS zone FROM (SELECT * FROM {_values(GRAPH, "route, type, outgoing, contextual, reasons, zone")} UNION ALL {PART_GRAPH})),
n AS (SELECT *, CASE WHEN route = '/' THEN 'home' WHEN regexp_matches(route, '^/donde-comer/(?:[^/]+/)?$') THEN 'hub' WHEN regexp_matches(route, '^/restaurantes/[^/]+/$') THEN 'ficha' WHEN regexp_matches(route, '^/guias/[^/]+/$') THEN 'guia' ELSE 'other' END AS kind FROM g),
ok AS (SELECT * FROM n WHERE type = 'indexable' OR (type = 'noindex' AND len(list_filter(reasons, lambda r: r NOT IN ('few-links', 'links-unknown'))) = 0 AND len(reasons) > 0)),
e AS (SELECT DISTINCT route AS src, unnest(outgoing) AS dst FROM ok),
h AS (SELECT DISTINCT u.route AS hub, f.route AS ficha FROM ok u JOIN ok f ON u.kind = 'hub' AND f.kind = 'ficha' AND (EXISTS (SELECT 1 FROM e WHERE src = u.route AND dst = f.route) OR EXISTS (SELECT 1 FROM e WHERE src = f.route AND dst = u.route))),
c AS (SELECT hub AS src, ficha AS dst, 0 AS rank, ficha AS detail FROM h UNION ALL SELECT ficha, hub, 1, hub FROM h
  UNION ALL SELECT a.ficha, b.ficha, 2, string_agg(a.hub, ',' ORDER BY a.hub) FROM h a JOIN h b ON a.hub = b.hub AND a.ficha <> b.ficha WHERE len(string_split(trim(a.hub, '/'), '/')) > 1 GROUP BY 1, 2
  UNION ALL SELECT a.route, b.route, 3, a.zone FROM ok a JOIN ok b ON a.zone = b.zone AND a.route <> b.route WHERE a.kind = 'ficha' AND b.kind = 'ficha')
"""


def _graph(spark, t):
    g = spark.createDataFrame(GRAPH, "route string, type string, outgoing string, contextual bigint, reasons string, zone string")
    part, lit, promo = t("part"), F.lit, F.col("p_type") == "PROMO"
    hub = F.concat(lit("/donde-comer/"), F.replace("p_brand", lit("#"), lit("-")), lit("-"), "p_size", lit("/"))
    pages = part.select(
        F.concat(lit("/restaurantes/p"), "p_partkey", lit("/")).alias("route"), F.when(promo, "noindex").otherwise("indexable").alias("type"), F.when(F.col("p_size") % 2 == 0, hub).otherwise("").alias("outgoing"), (F.col("p_size") % 4).cast("long").alias("contextual"),
        F.when(promo, F.when(F.col("p_retailprice") > 930, "demo").otherwise("few-links")).alias("reasons"), F.concat("p_brand", lit("/"), "p_size").alias("zone"),
    )
    hubs = part.select(hub.alias("route"), lit("indexable").alias("type"), lit("").alias("outgoing"), lit(1).cast("long").alias("contextual"), lit(None).cast("string").alias("reasons"), lit(None).cast("string").alias("zone")).distinct()
    g = g.unionByName(pages).unionByName(hubs)
    return g.select("route", "type", F.split("outgoing", ",").alias("outgoing"), "contextual", F.split("reasons", ",").alias("reasons"), "zone")


@query(
    NODES
    + """SELECT src, dst, ['hub-ficha', 'ficha-hub', 'ficha-hermana', 'misma-zona'][min(rank) + 1] AS reason, string_agg(detail, '; ' ORDER BY rank) AS detail, (SELECT contextual < 2 FROM ok WHERE route = dst) AS below
FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = c.src AND e.dst = c.dst) GROUP BY src, dst"""
)
def link_proposals(spark, t):
    return links.proposals(_graph(spark, t))


@query(NODES + "SELECT route, kind, route IN (SELECT route FROM ok) AS linkable FROM n")
def route_kinds(spark, t):
    g = _graph(spark, t)
    return g.select("route", links.route_kind(F.col("route")).alias("kind"), links.linkable(F.col("type"), F.col("reasons")).alias("linkable"))

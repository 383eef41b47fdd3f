"""Pieces of the SQL that checks the queries (ANSI with DuckDB's list functions)."""

from __future__ import annotations

from .data import tld_weights, words
from .functions.text import BREAKS

B = BREAKS


def quoted(names) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


def alternation(names) -> str:
    import re

    return "(" + "|".join(re.escape(n).replace("\\-", "-") for n in names).replace("'", "''") + ")"


def nbsp(t: str) -> str:
    return f"replace({t}, chr(160), ' ')"


def join_numbers(t: str) -> str:
    p = "'([0-9])[,.]([0-9])', '\\1\\2', 'g'"
    return f"regexp_replace(regexp_replace({t}, {p}), {p})"


def glue(t: str) -> str:
    return f"regexp_replace({t}, '[^A-Za-z0-9{B}]+[{B}]*', '', 'g')"


def word_list(t: str) -> str:
    return f"list_filter(string_split_regex(lower({glue(join_numbers(nbsp(t)))}), '[{B}]+'), lambda x: x <> '')"


def tokens(source: str = "documents", key: str = "doc_id", text: str = "text", name: str = "tok") -> str:
    """A CTE name(doc_id, term, loc)."""
    return (
        f"{name}_w AS (SELECT {key} AS doc_id, {word_list(text)} AS ws FROM {source}), "
        f"{name} AS (SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1)::INT AS loc FROM {name}_w)"
    )


POSTINGS = "post AS (SELECT term, doc_id, list_sort(list(loc)) AS pos, count(*)::BIGINT AS tf FROM tok GROUP BY term, doc_id)"

#: Page text without comments, sections, tags and entities.
STRIPPED = r"regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _t in ("script", "style", "svg"):
    STRIPPED = rf"regexp_replace({STRIPPED}, '(?is)<{_t}\b.*?</{_t}[^>]*>', '', 'g')"
PLAIN = rf"regexp_replace(regexp_replace(regexp_replace({STRIPPED}, '<[^>]*>', ' ', 'g'), '&rsquo;|&apos;|[''’]', '', 'g'), '&[^;<\s]*;?', ' ', 'g')"
TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
DOMAIN = r"regexp_extract(url, '^(?:https?://)?(?:www\.)?([^/]*)', 1)"
BARE_HOST = r"regexp_extract(lower(url), '^https?://(?:www\.)?([^/?#:]*)', 1)"
BARE_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
LINKS = r"""links0 AS (SELECT page_id, url AS src_url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]+)"', 1)) AS href FROM pages),
    links AS (SELECT page_id, src_url, href, CASE WHEN starts_with(href, '/') THEN regexp_extract(src_url, '^[^:]+://[^/]*', 0) || href ELSE href END AS url FROM links0)"""


def tld(ext: str, default: float) -> str:
    by: dict[float, list[str]] = {}
    for k, v in tld_weights().items():
        by.setdefault(v, []).append(k)
    return "CASE " + " ".join(f"WHEN {ext} IN ({quoted(n)}) THEN {v}::DOUBLE" for v, n in by.items()) + f" ELSE {default}::DOUBLE END"


def priority(url: str, seed: str, dom: str) -> str:
    rest = f"(CASE WHEN starts_with({url}, 'https') THEN substring({url}, 9) ELSE substring({url}, 8) END)"
    host, tail = f"regexp_extract({rest}, '^([^/?#]*)', 1)", f"regexp_extract({rest}, '^[^/?#]*(.*)$', 1)"

    def count(s: str, c: str) -> str:
        return f"(length({s}) - length(replace({s}, '{c}', '')))"

    return f"""CAST(trunc(CASE WHEN strlen({url}) >= 8 AND starts_with({url}, 'http') THEN
        (CASE WHEN starts_with({url}, 'https') THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END) * ({tld(f"regexp_extract({host}, '([^.]*)$', 1)", 0.8)})
        * greatest(pow(2.718::DOUBLE, trunc(-0.02::DOUBLE * ({seed}))), 0.5::DOUBLE) * greatest((50.0::DOUBLE - strlen({host})) / 50.0::DOUBLE, 0.5::DOUBLE)
        * (1.0::DOUBLE / (1.0::DOUBLE + 0.1::DOUBLE * greatest({count(host, '.')} - 1, 0)))
        * (1.0::DOUBLE / (1.0::DOUBLE + 0.25::DOUBLE * (length({host}) - length(regexp_replace({host}, '[0-9]', '', 'g')))))
        * greatest((150.0::DOUBLE - strlen({url})) / 100.0::DOUBLE, 0.5::DOUBLE) * greatest(1.0::DOUBLE - 0.1::DOUBLE * {count(tail, '/')}, 0.4::DOUBLE)
        * (CASE WHEN contains({tail}, '?') THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END) * greatest(pow(2.718::DOUBLE, trunc(-0.08::DOUBLE * ({dom}))), 0.3::DOUBLE) * 1000000000.0::DOUBLE
        ELSE 0 END) AS INT)"""


def bucket(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {b}000000 THEN {i}" for i, b in enumerate((400, 300, 200, 100, 50, 40, 30, 20))) + " ELSE 8 END"


def normalized(url: str = "url") -> str:
    """A query (page_id, url, normal) over pages."""
    return f"""u0 AS (SELECT page_id, url, regexp_extract(url, '^(https?)://', 1) AS scheme,
        regexp_replace(regexp_extract(url, '^https?://([^#]*)', 1), '(?i)^www\\.', '') AS rest FROM pages),
    u1 AS (SELECT *, regexp_extract(rest, '^([^/?]*)', 1) AS auth, regexp_extract(rest, '^[^/?]*(/[^?]*)', 1) AS path FROM u0),
    u2 AS (SELECT *, lower(regexp_replace(auth, CASE WHEN scheme = 'https' THEN ':443$' ELSE ':80$' END, '')) AS h FROM u1),
    u3 AS (SELECT *, scheme || '://' || h || CASE WHEN path = '' THEN '/' ELSE path END AS full_url,
        (strlen(url) < 1 OR strlen(url) > 2048 OR NOT regexp_matches(url, '^https?://') OR h = '' OR regexp_matches(lower(path), '{alternation(words("bad_extensions"))}$')
        OR contains(rest, '?') OR NOT regexp_matches(h || path, '^[A-Za-z0-9/_.:-]*$') OR NOT (contains(h, '.') AND list_extract(string_split(h, '.'), -1) IN ({quoted(words("allowed_tlds"))}))
        OR regexp_matches(h, '(^|\\.){alternation(words("blocked_domains"))}$') OR (length(h) > 3 AND regexp_matches(h, '^({"|".join(words("foreign_codes"))})\\.'))
        OR (length(path) >= 4 AND regexp_matches(lower(path), '^/({"|".join(words("foreign_codes"))})[/-]')) OR regexp_matches(h, '[^aeiouy.]{{10}}')
        OR regexp_matches(lower(path), '{alternation(words("junk_paths"))}') OR len(string_split(path, '/')) - 1 > 8) AS bad FROM u2),
    norm AS (SELECT page_id, url, CASE WHEN NOT bad THEN CASE WHEN length(path) > 1 THEN regexp_replace(full_url, '/$', '') ELSE full_url END END AS normal FROM u3)"""

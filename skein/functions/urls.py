"""URL functions: parts, filters and normalization as native column expressions. Filters are true for what is rejected."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..data import words

SCHEME = "^https?://"


def _any_of(names: tuple[str, ...]) -> str:
    return "(" + "|".join(re.escape(x).replace("\\-", "-") for x in names) + ")"


def domain(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:https?://)?(?:www\.)?([^/]*)", 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^(?:https?://)?([^/]*)", 1)


def parts(url: Column) -> dict[str, Column]:
    return {
        "service": F.regexp_extract(url, "^([a-z]+)://", 1),
        "host": F.regexp_extract(url, "^[a-z]+://([^/:]*)", 1),
        "port": F.regexp_extract(url, "^[a-z]+://[^/:]*:([0-9]+)", 1),
        "path": F.regexp_extract(url, "^[a-z]+://[^/]*/?(.*)$", 1),
    }


def bare_host(url: Column) -> Column:
    """Lower-case host without www., port, path, query, fragment."""
    return F.regexp_extract(F.lower(url), r"^https?://(?:www\.)?([^/?#:]*)", 1)


def bare_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)


def bad_scheme(url: Column) -> Column:
    return ~url.rlike(SCHEME)


def bad_extension(path: Column) -> Column:
    return F.lower(path).rlike(_any_of(words("bad_extensions")) + "$")


def has_query(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "").contains("?")


def strip_tracking(url: Column) -> Column:
    """The URL without tracking parameters; fragment dropped."""
    base = F.regexp_extract(url, "^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    key = lambda p: F.regexp_extract(p, "^([^=]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).startswith("utm_") & ~key(p).isin(*words("tracking_params"))), "&")
    return F.when(kept != "", F.concat(base, F.lit("?"), kept)).otherwise(base)


def bad_charset(host_path: Column) -> Column:
    return ~host_path.rlike("^[A-Za-z0-9/_.:-]*$")


def bad_tld(host: Column) -> Column:
    return ~(host.contains(".") & F.element_at(F.split(host, r"\."), -1).isin(*words("allowed_tlds")))


def blocked_domain(host: Column) -> Column:
    return F.lower(host).rlike(r"(^|\.)" + _any_of(words("blocked_domains")) + "$")


def foreign_locale(host: Column, path: Column) -> Column:
    codes = "(" + "|".join(words("foreign_codes")) + ")"
    in_host = (F.length(host) > 3) & F.lower(host).rlike(rf"^{codes}\.")
    return in_host | ((F.length(path) >= 4) & F.lower(path).rlike(f"^/{codes}[/-]"))


def gibberish(host: Column) -> Column:
    return F.lower(host).rlike("[^aeiouy.]{10}")


def junk_path(path: Column) -> Column:
    return F.lower(path).rlike(_any_of(words("junk_paths")))


def too_deep(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1 > 8


def blocked_keyword(url: Column) -> Column:
    return F.lower(url).rlike(_any_of(words("blocked_keywords")))


def normalize(url: Column) -> Column:
    """Normal form of an acceptable URL, null for one that any filter rejects.

    The default port goes and another one rejects; the host gets lower case and loses www.; the fragment
    and one slash at the end go.
    """
    scheme = F.regexp_extract(url, "^(https?)://", 1)
    rest = F.regexp_replace(F.regexp_extract(url, "^https?://([^#]*)", 1), r"^(?i)www\.", "")
    authority = F.regexp_extract(rest, "^([^/?]*)", 1)
    default = F.when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(F.regexp_replace(authority, ":80$", ""))
    h = F.lower(default)
    path = F.regexp_extract(rest, r"^[^/?]*(/[^?]*)", 1)
    bad = (
        (F.octet_length(url) < 1) | (F.octet_length(url) > 2048) | bad_scheme(url) | (h == "") | bad_extension(path) | rest.contains("?")
        | bad_charset(F.concat(h, path)) | bad_tld(h) | blocked_domain(h) | foreign_locale(h, path) | gibberish(h) | junk_path(path) | too_deep(path)
    )
    full = F.concat(scheme, F.lit("://"), h, F.when(path == "", "/").otherwise(path))
    return F.when(~bad, F.when(F.length(path) > 1, F.regexp_replace(full, "/$", "")).otherwise(full))


def shard(url: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lower(url)), F.lit(n)).cast("int")

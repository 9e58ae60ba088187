"""URL helpers.

Host and path are cut out with patterns because ``try_parse_url`` gives NULL for raw spaces and
umlauts, which occur in links of real pages.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from labelspark.functions.names import brand_words

_AUTHORITY = r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?"
_HOST = _AUTHORITY + r"([^/?#:\s]+)(?:[/?#:]|$)"
_PATH_AND_QUERY = _AUTHORITY + r"[^/?#\s]+([^#]*)"


def hostname(url: Column) -> Column:
    """Lower-case host, NULL when the text is no URL."""
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def domain(url: Column) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(hostname(url), r"^www\.", "")


def path_and_query(url: Column) -> Column:
    return F.regexp_extract(url, _PATH_AND_QUERY, 1)


def percent_decode(text: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone; NULL when the text is malformed."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def query_parameter(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(url, r"[?&]" + name + r"=([^&#]*)", 1), F.lit(""))


def _from_base64(text: Column) -> Column:
    """Decode unpadded or URL-safe base64; stray characters are dropped, so it never fails."""
    clean = F.regexp_replace(F.translate(text, "-_", "+/"), r"[^A-Za-z0-9+/]", "")
    usable = F.length(clean) - F.when(F.length(clean) % 4 == 1, 1).otherwise(0)
    clean = F.substring(clean, F.lit(1), usable)
    padded = F.rpad(clean, (F.ceil(F.length(clean) / 4) * 4).cast("int"), F.lit("="))
    return F.make_valid_utf8(F.unbase64(padded).cast("string"))


def decode_redirect(url: Column) -> Column:
    """The target of a search-engine redirect, or the URL itself."""
    packed = F.try_url_decode(query_parameter(url, "u"))
    target = _from_base64(F.substring(packed, F.lit(3), F.length(packed)))
    first = F.when(url.contains("bing.com/ck/a") & packed.startswith("a1") & target.startswith("http"), target)
    second = F.when(
        url.contains("duckduckgo.com/l/?uddg="), percent_decode(F.try_url_decode(query_parameter(url, "uddg")))
    )
    return F.coalesce(first, second, url)


def source_matches(url: Column, name: Column) -> Column:
    """Does the source belong to the supplier?  TRUE, FALSE, or NULL when it cannot be judged."""
    host = hostname(url)
    path = F.lower(percent_decode(path_and_query(url)))
    words = brand_words(name)
    found = F.exists(words, lambda w: host.contains(w) | path.contains(w))
    return F.when((F.size(words) > 0) & host.isNotNull() & path.isNotNull(), found)


def file_name(url: Column, default: str = "document.pdf") -> Column:
    """The last path segment before ``?``, decoded, or the default."""
    last = F.element_at(F.split(url, "/"), -1)
    name = F.element_at(F.split(last, r"\?"), 1)
    return F.coalesce(percent_decode(F.nullif(name, F.lit(""))), F.lit(default))

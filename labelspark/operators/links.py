"""Links: extraction from pages, scoring of document links, ranking of search results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from labelspark import constants as C
from labelspark.functions.markup import EDGES, absolute, parts_of_pages, percent_encode, web_address, without_dots
from labelspark.functions.names import brand_words, contains_any
from labelspark.functions.plan import settle
from labelspark.functions.urls import decode_redirect, hostname, path_and_query
from labelspark.operators.latest import best_candidate, best_per_key


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """Anchors, then images, of every page with absolute addresses; only web addresses are kept.

    Addresses are resolved against the first base of the page that has one, else against the page itself.
    """
    found = settle(pages.select(key, F.col(url).alias("_page"), F.col(markup).alias("_html")), {"_found": parts_of_pages("_html")})
    found = settle(found, {"_stated": web_address(F.col("_found.base"))}).select(
        key, F.coalesce(without_dots(absolute(F.col("_page"), F.col("_stated"))), F.col("_page")).alias("_base"),
        F.posexplode("_found.parts").alias("position", "_part"))
    links = found.filter(F.col("_part.href").isNotNull()).select(
        key, "position", F.col("_part.kind").alias("kind"), "_base", web_address(F.col("_part.href")).alias("_href"),
        F.regexp_replace(F.lower("_part.text"), EDGES, "").alias("text"),
        F.lower("_part.title").alias("title"), F.lower("_part.aria").alias("aria_label"), F.lower("_part.alt").alias("alt"),
    )
    links = settle(links, {"href": absolute(F.col("_base"), F.col("_href"))}).filter(F.col("href").startswith("http"))
    links = settle(links, {"href": without_dots(F.col("href"))})
    return settle(links, {"href": percent_encode(F.col("href"))}).select(
        key, "position", "kind", "href", "text", "title", "aria_label", "alt")


def document_link_score(href: Column, text: Column, title: Column, aria: Column, alt: Column) -> tuple[Column, Column]:
    """(type, score) of a link; the score is NULL for links that are no label documents."""
    address = F.lower(href)
    pdf = address.endswith(".pdf") | address.contains(".pdf?") | address.contains("/pdf/")
    image = address.rlike(r"\.(?:png|jpe?g)(?:\?|$)")
    everything = F.concat_ws(" ", text, address, title, aria, alt)
    points = C.LINK_SCORES

    def add(condition: Column, name: str) -> Column:
        return F.when(condition, points[name]).otherwise(0)

    score = (
        add(pdf, "pdf") + add(image, "image") + add(contains_any(address, C.LABEL_KEYWORDS), "keyword_href")
        + add(contains_any(text, C.LABEL_KEYWORDS) | contains_any(alt, C.LABEL_KEYWORDS), "keyword_text")
        + add(contains_any(address, C.DECORATION_WORDS), "decoration")
    )
    kind = F.when(pdf, "pdf").when(image, "image")
    return kind, F.when((pdf | image) & contains_any(everything, C.LABEL_KEYWORDS) & (score > 0), score)


def score_document_links(links: DataFrame, key: str = "page_id") -> DataFrame:
    """Label documents per page: each address once with its highest score."""
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in ("text", "title", "aria_label", "alt")}
    kind, score = document_link_score(F.col("href"), blank["text"], blank["title"], blank["aria_label"], blank["alt"])
    scored = settle(links.select(key, "href", "position", *[c.alias(n) for n, c in blank.items()]), {"type": kind, "score": score})
    scored = scored.filter(F.col("score").isNotNull()).withColumnRenamed("href", "url")
    return best_per_key(scored, [key, "url", "type"])


def rank_search_results(results: DataFrame) -> DataFrame:
    """Scores the addresses found for a supplier.  Needs ``provider_id, position, url, query``.

    Blacklisted hosts go.  When the query has usable words, only addresses that mention one in host or
    path stay: a foreign document is worse than none.
    """
    rows = settle(results, {"url": decode_redirect(F.col("url")), "_words": brand_words(F.col("query"))})
    rows = settle(rows, {"_address": F.lower("url"), "_host": hostname(F.col("url")), "_path": F.lower(path_and_query(F.col("url")))})
    address, host, path = F.col("_address"), F.col("_host"), F.col("_path")

    def any_word_in(text: Column) -> Column:
        return F.coalesce(F.exists("_words", lambda w: text.contains(w)), F.lit(False))

    rows = settle(rows, {"_in_host": any_word_in(host) & host.isNotNull(), "_in_path": any_word_in(path) & host.isNotNull()})
    in_host, in_path = F.col("_in_host"), F.col("_in_path") & ~F.col("_in_host")
    points = C.SEARCH_SCORES
    terms = [
        (address.rlike(r"\.pdf(?:$|[?#/])"), "pdf"), (in_host, "host"), (in_path, "path"),
        (address.contains("stromkennzeichnung") | address.contains("energiemix"), "keyword"),
        (contains_any(address, C.IRRELEVANT_URL_WORDS), "irrelevant"),
    ]
    score = reduce(lambda a, b: a + b, [F.when(c, points[n]).otherwise(0) for c, n in terms])
    accepted = ~contains_any(address, C.BLACKLISTED_DOMAINS) & ((F.size("_words") == 0) | in_host | in_path)
    return rows.filter(accepted).withColumn("score", score).drop("_words", "_address", "_host", "_path", "_in_host", "_in_path")


def choose_source(results: DataFrame) -> DataFrame:
    """The best address per supplier."""
    return best_candidate(rank_search_results(results), "provider_id")

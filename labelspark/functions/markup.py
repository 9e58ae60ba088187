"""HTML helpers: pages are read by one tokenizer over Arrow batches, addresses are put together on the JVM.

The tokenizer follows the states of a browser (text, tag, attributes, comment, raw text), so that a sign means what it means there:
``>`` in a quoted value ends no tag, ``</head>`` in a script ends no head.  It reads a page from left to right, once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from labelspark.functions.batches import in_slices

# White space as browsers and scripts understand it.  The rare characters stand behind one range test,
# which ASCII fails at once.
_RARE = r"[\u00a0-\uffff&&[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]"
# every run of white space that is not already a single blank
_RUN = r"[\t-\r" + _RARE + r"][\s" + _RARE + r"]*| [\s" + _RARE + "]+"
EDGES = r"^\s+|\s+$"
# fixed values: printable ASCII that stays as it is in a written-out address
_ADDRESS_CHARACTERS = "!#$%&'()*+,/:;=?@[]|~\\"

# Inside markup only these five characters are blanks.
_BLANK = " \t\n\f\r"
_NAME = rf"(?:=[^{_BLANK}/>=]*+|[^{_BLANK}/>=]++)"
_VALUE = rf"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^{_BLANK}>"'][^{_BLANK}>]*+)"""
_ATTRIBUTE = re.compile(rf"({_NAME})(?:[{_BLANK}]*+=[{_BLANK}]*+({_VALUE})?+)?+")
_TAG = re.compile(rf"<(/?)([A-Za-z][^{_BLANK}/>]*+)((?:[{_BLANK}/]++|{_NAME}(?:[{_BLANK}]*+=[{_BLANK}]*+{_VALUE}?+)?+)*+)(>?)")
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.DOTALL)
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*(;|(?![A-Za-z0-9=])))")
# Elements whose content is no markup, those that a head may hold, and what is never shown.
RAW_TEXT = frozenset({"script", "style", "noscript", "iframe", "noembed", "noframes", "xmp"})
ESCAPABLE = frozenset({"title", "textarea"})  # no markup either, but character references
HEAD_ONLY = frozenset({"title", "meta", "link", "base", "basefont", "bgsound", "script", "style", "noscript", "noframes", "template"})
HIDDEN = frozenset({"script", "style", "noscript"})
_ENDS = {name: re.compile(rf"</{name}(?=[{_BLANK}/>])", re.IGNORECASE) for name in RAW_TEXT | ESCAPABLE}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content) from left to right.

    ``start``: element and its attributes as written; ``end``: element; ``text``: the element whose content is no markup, else
    empty, and the text as written.  Comments, declarations and a tag cut off by the end of the page give nothing.
    """
    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            yield "text", "", page[at:mark]
        if mark == size:
            return
        follower = page[mark + 1:mark + 2]
        if follower == "!" or follower == "?" or (follower == "/" and not page[mark + 2:mark + 3].isascii()):
            comment = _COMMENT.match(page, mark)
            at = comment.end() if comment else _after(page, mark)
            continue
        tag = _TAG.match(page, mark)
        if tag is None:
            if follower == "/" and mark + 2 < size:  # an end tag without a name
                at = _after(page, mark)
            else:
                yield "text", "", page[mark:mark + 1]
                at = mark + 1
            continue
        if not tag[4]:
            return  # the page ends inside a tag
        name, at = tag[2].lower(), tag.end()
        if tag[1]:
            yield "end", name, ""
            continue
        yield "start", name, tag[3]
        if name in _ENDS:
            end = _ENDS[name].search(page, at)
            stop = end.start() if end else size
            if stop > at:
                yield "text", name, page[at:stop]
            at = stop
        elif name == "plaintext":
            yield "text", name, page[at:]
            return


def _after(page: str, at: int) -> int:
    """Behind the next ``>``, or the end of the page."""
    found = page.find(">", at)
    return len(page) if found < 0 else found + 1


def _text(name: str, content: str) -> str:
    return content if name in RAW_TEXT or name == "plaintext" or "&" not in content else html.unescape(content)


def visible_text(page: str) -> str:
    """The text of the body, as it stands: without markup, comments, scripts, styles, noscript, and the head.

    A head need not be written: what only a head holds belongs to it until something else comes.
    """
    out, in_body, templates = [], False, 0
    for kind, name, content in tokens(page):
        if templates:  # in the head; a template's content is no part of the page
            templates += (name == "template") * ((kind == "start") - (kind == "end"))
        elif kind == "start":
            if not in_body and name == "template":
                templates = 1
            in_body = in_body or not (name in HEAD_ONLY or name in ("html", "head"))
        elif kind == "text" and name not in HIDDEN:
            if not in_body and (name in HEAD_ONLY or not content.strip(_BLANK)):
                continue
            in_body = True
            out.append(_text(name, content))
    return "".join(out)


def attributes(tag: str) -> dict[str, str]:
    """The attributes of a start tag with their decoded values; of a repeated one the first counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(tag):
        if value[:1] in ('"', "'"):
            value = value[1:-1] if value[-1] == value[0] and len(value) > 1 else value[1:]
        found.setdefault(name.lower(), decode_attribute(value))
    return found


def decode_attribute(value: str) -> str:
    """Character references in an attribute value: a name without semicolon counts only if it is an old one and neither a letter,
    a digit nor ``=`` follows, so that ``?a=1&copy=2`` stays a query string."""
    def decode(found: re.Match) -> str:
        reference = found.group()
        return reference if reference[1] != "#" and reference[1:] not in html5 else html.unescape(reference)

    return _REFERENCE.sub(decode, value) if "&" in value else value


def page_parts(page: str) -> tuple[str | None, list[tuple]]:
    """(href of the first base that has one, (kind, href, text, title, aria-label, alt) of every anchor, then every image).

    An anchor ends at its end tag or where the next one starts.  Scripts and styles are no part of its text.  An absent address is None.
    """
    base, anchors, images, text = None, [], [], None
    for kind, name, content in tokens(page):
        if kind == "text":
            if text is not None and name not in HIDDEN:
                text.append(_text(name, content))
        elif name == "a":
            if text is not None:
                anchors[-1][2] = "".join(text)
                text = None
            if kind == "start":
                given = attributes(content)
                anchors.append(["a", given.get("href"), "", given.get("title", ""), given.get("aria-label", ""), ""])
                text = []
        elif kind == "start" and name in ("img", "image"):
            given = attributes(content)
            images.append(("img", given.get("src") or None, "", given.get("title", ""), given.get("aria-label", ""), given.get("alt", "")))
        elif kind == "start" and name == "base" and base is None:
            base = attributes(content).get("href")
    if text is not None:
        anchors[-1][2] = "".join(text)
    return base, [*map(tuple, anchors), *images]


@F.arrow_udf(T.StringType())
def visible_texts(page: pa.Array) -> pa.Array:
    """:func:`visible_text` of a column."""
    return in_slices(page, lambda p: None if p is None else visible_text(p), pa.string())


_FIELDS = ("kind", "href", "text", "title", "aria", "alt")
_PARTS = T.StructType([T.StructField("base", T.StringType()), T.StructField("parts", T.ArrayType(
    T.StructType([T.StructField(name, T.StringType()) for name in _FIELDS])))])


_ARROW_PARTS = pa.struct([("base", pa.string()), ("parts", pa.list_(pa.struct([(name, pa.string()) for name in _FIELDS])))])


def _parts(page: str | None) -> dict:
    base, parts = (None, []) if page is None else page_parts(page)
    return {"base": base, "parts": [dict(zip(_FIELDS, part, strict=True)) for part in parts]}


@F.arrow_udf(_PARTS)
def parts_of_pages(page: pa.Array) -> pa.Array:
    """:func:`page_parts` of a column; a null page has none."""
    return in_slices(page, _parts, _ARROW_PARTS)


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, _RUN, " ")


def web_address(href: Column) -> Column:
    """An address as a browser reads it: without blanks and control characters at its ends, and without tabs and line breaks."""
    return F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]+", "")


def without_dots(url: Column) -> Column:
    """Resolve ``.`` and ``..`` in the path of an absolute URL."""
    dotted = url.rlike(r"^[^?#]*/\.{1,2}(?:[/?#]|$)")
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"^[^?#]*([?#].*)?$", 1)
    kept = F.aggregate(
        F.split(path, "/"), F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(s == ".", acc).otherwise(F.array_append(acc, s)))
    slash = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(dotted, F.concat(origin, F.array_join(kept, "/"), slash, rest)).otherwise(url)


def percent_encode(url: Column) -> Column:
    """Spaces and non-ASCII characters of an address written as ``%XX``, all else unchanged."""
    out = F.replace(F.url_encode(url), F.lit("+"), F.lit("%20"))
    for c in _ADDRESS_CHARACTERS:
        if c not in "%*":
            out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    out = F.replace(out, F.lit("%25"), F.lit("%"))
    return F.when(url.rlike(r"[^\x21-\x7e]"), out).otherwise(url)


def absolute(base: Column, href: Column) -> Column:
    """A link of a page as an absolute URL, before :func:`without_dots` and :func:`percent_encode`."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    document = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/(?:[^?#]*/)?)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href == "", base)
        .when(href.startswith("?"), F.concat(document, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .otherwise(F.concat(F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder), href))
    )

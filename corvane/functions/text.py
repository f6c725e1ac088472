"""Text functions as Column expressions; all run inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stored ids and hashes depend on them.
POINT_NAMESPACE = "6f8e2b0a1c3d4e5f8a9b0c1d2e3f4a5b"
CHARS_PER_TOKEN = 4
BREADCRUMB_SEPARATOR = " > "

TERM = r"[\p{L}\p{N}]+"
SENTENCE_END = r"(?<=[.!?])\s+"


def blank(c: Column) -> Column:
    """Null as an empty string."""
    return F.coalesce(c, F.lit(""))


def normalise(c: Column) -> Column:
    """Each run of white space, in Unicode's sense, as one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def token_estimate(c: Column) -> Column:
    """A quarter of the code points, rounded up; at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.char_length(c) / CHARS_PER_TOKEN).cast("int"))


def word_count(c: Column) -> Column:
    """A token counter for tests: words."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def content_hash(title: Column, text: Column) -> Column:
    """SHA-256 of the stripped title, a line feed and the text. Only they decide whether a page has changed."""
    return F.sha2(F.concat(strip(blank(title)), F.lit("\n"), blank(text)), 256)


def hash_preview(c: Column) -> Column:
    return F.substring(c, 1, 12)


def join_filled(parts: Column, separator: str) -> Column:
    """Join the parts that are neither null nor empty."""
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), separator)


def breadcrumb(space: Column, ancestors: Column, title: Column) -> Column:
    return join_filled(F.concat(F.array(blank(space)), F.coalesce(ancestors, F.array().cast("array<string>")), F.array(blank(title))), BREADCRUMB_SEPARATOR)


def page_url(base: Column, web: Column) -> Column:
    """Base without its trailing slashes, then the page's own part; if one is empty, the other."""
    return F.concat(F.regexp_replace(blank(base), "/+$", ""), blank(web))


def names(objects: Column, field: str) -> Column:
    """A field of each struct of an array, in order, without null and empty ones."""
    return F.filter(F.transform(F.coalesce(objects, F.array().cast(f"array<struct<{field}:string>>")), lambda x: x[field]), lambda x: x.isNotNull() & (x != ""))


def chunk_id(page_id: Column, ordinal: Column) -> Column:
    return F.concat_ws(":", page_id.cast("string"), ordinal.cast("string"))


def point_id(key: Column) -> Column:
    """UUID version 5 of a chunk id in a fixed namespace, from SHA-1 and the version and variant bits."""
    h = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE)), key.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63)).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def chunk_text(crumb: Column, body: Column) -> Column:
    return F.concat(crumb, F.lit("\n\n"), body)


def terms(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(blank(c)), F.lit(TERM), F.lit(0))


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, SENTENCE_END), lambda x: x != "")


def html_text(html: Column) -> Column:
    """Text of a page's body by patterns: without scripts, styles, comments and markup; the named entities that wiki pages hold are decoded, & last. operators.parse has a parser for the general case."""
    body = F.regexp_extract(blank(html), r"(?is)<body[^>]*>(.*)$", 1)
    body = F.when(body != "", body).otherwise(blank(html))
    for pattern in (r"(?is)<(script|style|noscript|template)[^>]*>.*?</\1>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        body = F.regexp_replace(body, pattern, " ")
    for entity, text in (("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&")):
        body = F.replace(body, F.lit(f"&{entity};"), F.lit(text))
    return normalise(body)


def event_page_id(payload: Column) -> Column:
    """The page that an event is about: the first of four places that holds an id."""
    return F.coalesce(*(F.get_json_object(payload, p) for p in ("$.page.id", "$.content.id", "$.page_id", "$.id")))


def event_name(payload: Column) -> Column:
    first = F.get_json_object(payload, "$.event")
    return F.lower(F.coalesce(F.when(first != "", first), F.get_json_object(payload, "$.eventType"), F.lit("")))


# Events whose name holds one of these delete a page.
DELETE_EVENTS = ("page_removed", "page_trashed", "page_deleted")


def is_delete(name: Column) -> Column:
    return F.coalesce(name.rlike("|".join(DELETE_EVENTS)), F.lit(False))


def comma_list(c: Column) -> Column:
    """The trimmed parts between commas, without empty ones."""
    return F.filter(F.transform(F.split(blank(c), ","), lambda x: F.trim(x)), lambda x: x != "")

"""Text measures: message bodies, identifiers in text, sections, URLs, safe output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a trailer line and an email-shaped string look like.
TRAILER = r"^[ \t]*[A-Za-z-]+:[ \t]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def body_lines(message: Column) -> Column:
    """Lines after the first that are neither blank nor trailers, without trailing white space."""
    lines = F.split(message, "\n")
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    bare = F.transform(rest, lambda x: F.regexp_replace(x, "[ \\t\\r]+$", ""))
    return F.filter(bare, lambda x: (x != "") & ~x.rlike(TRAILER))


def body_chars(message: Column) -> Column:
    """Characters of the body; NULL for an unknown message."""
    return F.when(message.isNotNull(), F.aggregate(body_lines(message), F.lit(0).cast("long"), lambda s, x: s + F.length(x)))


def has_body(message: Column) -> Column:
    return (body_chars(message) > 0).cast("long")


def flattened(x: Column) -> Column:
    return F.regexp_replace(x, "[\\t\\n\\r]", " ")


def capped(x: Column, most: int) -> Column:
    """At most `most` characters, marked where cut."""
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most - 1)), F.lit("~"))).otherwise(x)


def for_script(json: Column) -> Column:
    """JSON that can stand inside an HTML script element."""
    return F.replace(F.replace(json, F.lit("</"), F.lit("<\\/")), F.lit("<!--"), F.lit("<\\!--"))


def normal_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, `/` for an empty path."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    scheme, host = F.lower(F.regexp_extract(url, pattern, 1)), F.lower(F.regexp_extract(url, pattern, 2))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(host)
    path, query = F.regexp_extract(url, pattern, 3), F.regexp_extract(url, pattern, 4)
    return F.when(scheme == "", url).otherwise(F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query))


def blocks(text: Column, tag: str) -> Column:
    """Contents of all `<!-- tag ... -->` blocks; element_at(-1) is the one that counts."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)<!--\\s*{tag}\\b(.*?)-->"), F.lit(1)), lambda x: F.trim(x))


def section(text: Column, heading: str) -> Column:
    """Lines under a Markdown heading up to the next one."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, lambda x: F.lower(F.trim(F.regexp_replace(x, "^#+", "")))), heading.lower())
    rest = F.slice(lines, (at + 1).cast("int"), F.greatest(F.size(lines) - at, F.lit(0)).cast("int"))
    heads = F.transform(rest, lambda x: x.rlike("^#{1,6} "))
    stop = F.array_position(heads, True)
    return F.when(at > 0, F.when(stop > 0, F.slice(rest, F.lit(1), (stop - 1).cast("int"))).otherwise(rest))

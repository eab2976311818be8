"""URL parts, resolution and the names derived from URLs."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, functions as F

from pageloom.functions.text import UNSAFE_NAME, or_else, slugify, strip

_SPLIT = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?"

# Content type to file extension, and back.
MIME_EXTENSIONS = {
    "image/jpeg": ".jpg",
    "image/png": ".png",
    "image/gif": ".gif",
    "image/webp": ".webp",
    "image/svg+xml": ".svg",
    "image/bmp": ".bmp",
    "image/tiff": ".tiff",
    "image/x-icon": ".ico",
    "image/vnd.microsoft.icon": ".ico",
    "image/avif": ".avif",
    "image/heic": ".heic",
    "text/html": ".html",
    "text/plain": ".txt",
    "application/pdf": ".pdf",
}
EXTENSION_MIMES = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".webp": "image/webp",
    ".svg": "image/svg+xml",
    ".bmp": "image/bmp",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".ico": "image/vnd.microsoft.icon",
    ".avif": "image/avif",
    ".heic": "image/heic",
    ".html": "text/html",
    ".txt": "text/plain",
    ".pdf": "application/pdf",
}


# All other types and extensions as the standard library lists them.
_STANDARD = mimetypes.MimeTypes()
MIME_EXTENSIONS = {
    **{t: _STANDARD.guess_extension(t) for t in sorted(set(_STANDARD.types_map[1].values()))}, **MIME_EXTENSIONS
}
EXTENSION_MIMES = {**_STANDARD.types_map[1], **EXTENSION_MIMES}


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _SPLIT, group)


def url_netloc(url: Column) -> Column:
    """Authority as written, port and user info included; works on URLs with spaces too."""
    return _part(url, 2)


def url_host(url: Column) -> Column:
    """Lower-case authority without one leading ``www.``."""
    return F.regexp_replace(F.lower(url_netloc(url)), r"^www\.", "")


def url_path(url: Column) -> Column:
    return _part(url, 3)


def url_slug(url: Column) -> Column:
    """Slug of the path, 'index' for an empty one; the query is ignored."""
    path = F.regexp_replace(url_path(url), "^/+|/+$", "")
    return slugify(or_else(path, F.lit("index")))


def raw_file_name(ordinal: Column, url: Column) -> Column:
    """``007-some-slug.html``; numbers over three digits keep their width."""
    return F.concat(F.regexp_replace(F.concat(F.lit("00"), ordinal.cast("string")), "^0{1,2}(?=[0-9]{3})", ""), F.lit("-"), url_slug(url), F.lit(".html"))


def _remove_dots(path: Column, drop_empty: bool) -> Column:
    segments = F.split(path, "/", -1)
    count = F.size(segments)
    if drop_empty:
        kept = F.filter(segments, lambda s, i: (s != "") | (i == 0) | (i == count - 1))
    else:
        kept = segments
    resolved = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    closed = F.when(
        F.element_at(segments, -1).isin(".", ".."), F.concat(resolved, F.array(F.lit("")))
    ).otherwise(resolved)
    return F.concat(F.lit("/"), F.regexp_replace(F.array_join(closed, "/"), "^/", ""))


def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute form of ``ref`` seen from ``base``."""
    site = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    path, tail = _part(ref, 3), F.concat(_part(ref, 4), _part(ref, 5))
    folder = or_else(F.regexp_replace(_part(base, 3), "[^/]*$", ""), F.lit("/"))
    return (
        F.when(ref == "", base)
        .when(ref.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(_part(base, 1), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(site, _remove_dots(path, False), tail))
        .when(ref.startswith("?"), F.concat(site, _part(base, 3), tail))
        .when(ref.startswith("#"), F.concat(site, _part(base, 3), _part(base, 4), tail))
        .otherwise(F.concat(site, _remove_dots(F.concat(folder, path), True), tail))
    )


def unquote(text: Column) -> Column:
    """Percent-decoding run by run: ``+`` and any ``%`` without two digits stay as they are."""
    pieces = F.regexp_extract_all(text, F.lit("(?:%[0-9a-fA-F]{2})+|[^%]+|%"), F.lit(0))
    decoded = F.transform(pieces, lambda p: F.when(p.rlike("^%.."), F.coalesce(F.try_url_decode(p), p)).otherwise(p))
    return F.when(text.contains("%"), F.array_join(decoded, "")).otherwise(text)


def url_basename(url: Column) -> Column:
    return F.regexp_extract(url_path(url), "[^/]*$", 0)


def image_title(src: Column) -> Column:
    """Readable title from the file name, 'image' when nothing is left."""
    stem = F.regexp_replace(url_basename(src), r"(?<=[^.])\.[^.]*$", "")
    words = strip(F.translate(unquote(stem), "_-", "  "))
    return or_else(words, F.lit("image"))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), key)


def bare_mime(content_type: Column) -> Column:
    return strip(F.get(F.split(content_type, ";"), F.lit(0)))


def mime_extension(content_type: Column) -> Column:
    """File extension of a content type, ``.jpg`` when unknown or missing."""
    return F.coalesce(_lookup(MIME_EXTENSIONS, F.lower(bare_mime(content_type))), F.lit(".jpg"))


def mime_type(content_type: Column, name: Column) -> Column:
    """Content type as sent, else by file name, else ``image/jpeg``."""
    sent = bare_mime(content_type)
    by_name = _lookup(EXTENSION_MIMES, F.lower(F.regexp_extract(name, r"\.[^.]*$", 0)))
    return or_else(sent, F.coalesce(by_name, F.lit("image/jpeg")))


def safe_filename(url: Column, content_type: Column | None = None) -> Column:
    """File-system safe name of an asset."""
    name = unquote(url_basename(url))
    ext = F.lit(".jpg") if content_type is None else mime_extension(content_type)
    named = or_else(F.regexp_extract(name, r"(?s)^.*\..*$", 0), F.concat(F.lit("image"), ext))
    safe = F.regexp_replace(F.regexp_replace(named, UNSAFE_NAME, "-"), "^-+|-+$", "")
    return or_else(safe, F.lit("image.jpg"))

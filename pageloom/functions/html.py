"""HTML tokens, attributes, entities and escaping as Column expressions."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, functions as F

# One alternative per node kind. Quotes count after "=" only. Comments, scripts and styles that never close run to the
# end of the page, and an unquoted attribute may not contain "<"; both keep the match linear.
NODE_PATTERN = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script\b.*?(?:</script\s*>|\z)"
    r"|<style\b.*?(?:</style\s*>|\z)"
    r"|</?[a-z](?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^<>])*+>"
    r"|<[!?][^>]*(?:>|\z)"
    r"|(?:[^<]|<[^a-z/!?<])[^<]*(?:<[^a-z/!?<][^<]*)*+"
    r"|<"
)
ATTR_PATTERN = r"""\s([a-zA-Z_:][-a-zA-Z0-9_:.]*)(\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
ENTITY_PATTERN = r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&"

# Entities replaced directly; "&amp;" is last so that a decoded "&" is never read again.
COMMON_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&#x27;", "'"),
    ("&nbsp;", "\u00a0"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
)
_COMMON_PATTERN = "&(lt|gt|quot|#39|#x27|nbsp|copy|middot|amp);"


def node_tokens(html: Column) -> Column:
    """Array of every node token of a page, in document order; nothing is lost."""
    return F.regexp_extract_all(html, F.lit(NODE_PATTERN), F.lit(0))


def token_tag(tok: Column) -> Column:
    """Lower-case tag name of a tag token, '' for text."""
    return F.when(
        tok.startswith("<"), F.lower(F.regexp_extract(tok, r"^</?([a-zA-Z][a-zA-Z0-9-]*)", 1))
    ).otherwise(F.lit(""))


def attribute(tok: Column, name: str | Column, normal: bool = False) -> Column:
    """Decoded value of an attribute (lower-case ``name``); '' when present without a value, NULL when absent.

    The first occurrence wins, and text inside another attribute's quotes never matches. ``normal`` is for tokens
    whose character references went through :func:`normalize_entities`.
    """
    names = F.transform(F.regexp_extract_all(tok, F.lit(ATTR_PATTERN), F.lit(1)), F.lower)
    values = F.regexp_extract_all(tok, F.lit(ATTR_PATTERN), F.lit(3))
    raw = F.get(values, (F.array_position(names, name) - 1).cast("int"))
    # The transform over one element binds the value, so that it is written once in the plan.
    bound = F.transform(F.array(F.regexp_replace(raw, "^[\"']|[\"']$", "")), decode_known if normal else decode_attribute)
    return F.get(bound, F.lit(0))


def attribute_of(tok: Column, name: str) -> Column:
    """Like :func:`attribute` for tokens of the node table, skipping the attribute scan for those that cannot have it."""
    return F.when(F.lower(tok).contains(name), attribute(tok, name, normal=True))


# Numbers 128-159 mean the characters of the old Western code page.
_WESTERN = bytes(range(128, 160)).decode("cp1252", errors="replace")
# The names of the standard, and those among them that count without the semicolon, longest first.
_NAMES = {name[:-1]: chars for name, chars in html5.items() if name.endswith(";")}
_BARE = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n)))


def _code_point(number: Column) -> Column:
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    encoded = F.unhex(F.lpad(F.hex(number), 8, "0"))
    western = F.substring(F.lit(_WESTERN), (number - 127).cast("int"), F.lit(1))
    return F.when(number.between(128, 159) & (western != "\ufffd"), western).when(
        valid, F.decode(encoded, "UTF-32")).otherwise(F.lit("\ufffd"))


def _number(digits: Column, base: int) -> Column:
    """Value of a run of digits, whatever its leading zeros; too large for a character gives -1."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    value = F.conv(short, 16, 10) if base == 16 else short
    return F.when(F.length(short) <= 8, value.cast("bigint")).otherwise(F.lit(-1))


def _decode_pieces(pieces: Column, use) -> Column:
    """``use(piece, decoded)`` for every piece, joined. The table of names is written once."""
    table = "\x02".join(f"{name}\x01{chars}" for name, chars in _NAMES.items())
    names = F.str_to_map(F.lit(table), F.lit("\x02"), F.lit("\x01"))
    joined = F.transform(F.array(names), lambda n: F.array_join(F.transform(pieces, lambda p: use(p, _decode_piece(p, n))), ""))
    return F.get(joined, F.lit(0))


def _decode_piece(piece: Column, names: Column) -> Column:
    known = F.element_at(names, F.regexp_extract(piece, "^&(.*);$", 1))
    bare = F.regexp_extract(piece, f"^&({_BARE})", 1)
    return (
        F.when(piece.rlike("^&#[xX]"), _code_point(_number(F.regexp_extract(piece, "[xX]([0-9a-fA-F]+)", 1), 16)))
        .when(piece.rlike("^&#"), _code_point(_number(F.regexp_extract(piece, "#([0-9]+)", 1), 10)))
        .when(piece.rlike("^&[a-zA-Z]"), F.coalesce(
            known,
            F.when(bare != "", F.concat(F.element_at(names, bare), F.substr(piece, F.length(bare) + 2))),
            piece))
        .otherwise(piece)
    )


def decode_entities(text: Column) -> Column:
    """Character references to characters; unknown names stay as written.

    All names of the standard count, the old ones also without their semicolon, and numbers of any
    length; what names no character becomes U+FFFD.
    """
    pieces = F.regexp_extract_all(text, F.lit(ENTITY_PATTERN), F.lit(0))
    return (
        F.when(~text.contains("&"), text).when(_common_only(text), decode_known(text))
        .otherwise(_decode_pieces(pieces, lambda piece, decoded: decoded))
    )


def _common_only(text: Column) -> Column:
    return ~F.regexp_replace(text, _COMMON_PATTERN, "").contains("&")


def decode_known(text: Column) -> Column:
    """:func:`decode_entities` for text that went through :func:`normalize_entities`: a few replacements."""
    common = text
    for entity, char in COMMON_ENTITIES:
        common = F.replace(common, F.lit(entity), F.lit(char))
    return F.when(text.contains("&"), common).otherwise(text)


def normalize_entities(tok: Column, in_tag: Column) -> Column:
    """A text or tag token in which only the common character references are left, and "&" that names nothing.

    Done once per token, when the node table is made, so that whoever reads a token later needs a few replacements instead of the table
    of names. Characters that mean something in markup come out as their common reference. In tags, names without semicolon stay.
    """
    source = F.when(in_tag, F.regexp_replace(tok, _BARE_NAME, "&amp;")).otherwise(tok)
    pieces = F.regexp_extract_all(source, F.lit(ENTITY_PATTERN), F.lit(0))

    def kept(piece: Column, decoded: Column) -> Column:
        escaped = F.replace(escape_text(decoded), F.lit('"'), F.lit("&quot;"))
        common = ~piece.startswith("&") | piece.rlike(f"^(?:{_COMMON_PATTERN})$")
        return F.when(common | (piece == decoded), piece).otherwise(F.replace(escaped, F.lit("'"), F.lit("&#39;")))

    return F.when(F.coalesce(~tok.contains("&") | _common_only(tok), F.lit(True)), tok).otherwise(_decode_pieces(pieces, kept))


_BARE_NAME = "&(?=[a-zA-Z][a-zA-Z0-9]*(?![a-zA-Z0-9;]))"


def decode_attribute(text: Column) -> Column:
    """Like :func:`decode_entities`, but a name without semicolon stays, as in ``?a=1&copy=2``."""
    shielded = F.regexp_replace(text, _BARE_NAME, "&amp;")
    return F.when(~text.contains("&"), text).otherwise(decode_entities(shielded))


def escape_text(text: Column) -> Column:
    """Serializer escaping of text nodes: only & < >."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def html_escape(text: Column) -> Column:
    """Escaping for XML fields and attribute values: & < > and both quotes."""
    text = escape_text(text)
    text = F.replace(text, F.lit('"'), F.lit("&quot;"))
    return F.replace(text, F.lit("'"), F.lit("&#x27;"))


def cdata_wrap(text: Column) -> Column:
    """CDATA section; a literal "]]>" is split over two sections."""
    inner = F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return F.concat(F.lit("<![CDATA["), inner, F.lit("]]>"))

"""Pieces of stored HTML as Spark column expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicspark.functions.binding import let
from civicspark.functions.urls import basename, path_of

# One attribute that is not href, then the href value with or without quotes.
_OTHER_ATTRIBUTE = r"""\s+(?!href\s*=)[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
_ANCHOR_HREF = rf"""(?i)<a(?:{_OTHER_ATTRIBUTE})*\s+href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_HIDDEN = r"(?is)<(?:!--.*?--|script\b.*?</script\s*|style\b.*?</style\s*)>"

# A numbered reference, or up to 32 characters that may begin with a name, or text between references.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_TOKENS = rf"(?s){_REFERENCE}|[^&]+|&"
# The names that need no semicolon, longest first.
_BEGUN = f"^&({'|'.join(sorted((n for n in html5 if not n.endswith(';')), key=len, reverse=True))})"


def _names() -> Column:
    """Text of every reference name of HTML 5, as one constant map."""
    return F.from_json(F.lit(json.dumps(html5)), "map<string,string>")


def _old_codes() -> Column:
    """Numbers 128 to 159 stand for the characters of the Windows code page, where it has one."""
    old = {}
    for code in range(0x80, 0xA0):
        try:
            old[f"{code:X}"] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            old[f"{code:X}"] = chr(code)
    return F.from_json(F.lit(json.dumps(old)), "map<string,string>")


def _numbered(token: Column) -> Column:
    """Character of ``&#...``: U+FFFD for zero, surrogates and numbers beyond Unicode, nothing for codes that are no characters."""
    digits = F.regexp_extract(token, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    is_hex = F.lower(F.substr(token, F.lit(3), F.lit(1))) == "x"
    # Longer numbers than eight digits are beyond Unicode whatever they are.
    code = F.when(F.length(digits) > 8, F.lit(1 << 32)).when(digits == "", F.lit(0).cast("long")).otherwise(
        F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
    )

    def char(c: Column) -> Column:
        none = c.between(1, 8) | (c == 11) | c.between(14, 31) | (c == 127) | c.between(0xFDD0, 0xFDEF)
        return (
            F.when((c == 0) | c.between(0xD800, 0xDFFF) | (c > 0x10FFFF), "�")
            .when(c.between(0x80, 0x9F), F.try_element_at(_old_codes(), F.hex(c)))
            .when(none | (c.bitwiseAND(0xFFFE) == 0xFFFE), "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))
        )

    return let(code, char)


def _named(token: Column) -> Column:
    """Text of ``&name``: of the whole name, else of the longest name that it begins with."""
    names, name = _names(), F.substr(token, F.lit(2))
    # A map is searched entry by entry, so it is asked for names only.
    whole = F.when(name.rlike(r"^[A-Za-z][A-Za-z0-9]*+;?\z"), F.try_element_at(names, name))
    begun = let(F.regexp_extract(token, _BEGUN, 1), lambda start: F.when(
        start != "", F.concat(F.try_element_at(names, start), F.substr(token, F.length(start) + 2))
    ))
    return F.when(token == "&amp;", "&").otherwise(F.coalesce(whole, begun, token))


def decode_references(text: Column) -> Column:
    """Decode every character reference once, from left to right, as HTML 5 says."""
    numbered = r"^&#([0-9]|[xX][0-9a-fA-F])"
    pieces = F.transform(
        F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)),
        lambda t: F.when(~t.startswith("&") | (t == "&"), t).when(t.rlike(numbered), _numbered(t)).otherwise(_named(t)),
    )
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def hrefs(html: Column) -> Column:
    """``href`` values of all anchors outside comments, scripts and styles, in page order."""
    hides = html.contains("<!--") | html.contains("<s") | html.contains("<S")
    visible = F.when(hides, F.regexp_replace(html, _HIDDEN, "")).otherwise(html)
    return F.transform(F.regexp_extract_all(visible, F.lit(_ANCHOR_HREF), F.lit(1)), _href_value)


def _href_value(raw: Column) -> Column:
    """Without quotes and with character references decoded."""
    quoted = raw.startswith('"') | raw.startswith("'")
    bare = F.when(quoted, F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return decode_references(bare)


def page_title(html: Column) -> Column:
    """Text of the first title element, NULL if the page has none."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<title\b[^>]*>(.*?)</title\s*>"), F.lit(1))
    return decode_references(F.get(found, F.lit(0)))


def page_title_slug(html: Column, url: Column, words: int = 50, stamp: Column | None = None) -> Column:
    """First ``words`` words of the title and the URL base name, joined by ``_``.

    With the timestamp ``stamp`` it is a file name: the time follows, then ``.html``.
    """
    title = F.coalesce(page_title(html), F.lit("webpage"))
    tokens = F.split(F.regexp_replace(title, r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
    base = basename(path_of(url))
    slug = F.concat_ws(
        "_",
        F.array_join(F.slice(tokens, 1, words), "_"),
        F.when(base == "", "index").otherwise(base),
    )
    if stamp is None:
        return slug
    return F.concat(slug, F.lit("_"), F.date_format(stamp, "yyyyMMddHHmmss"), F.lit(".html"))


def mime_type(content_type: Column) -> Column:
    return F.coalesce(F.split_part(content_type, F.lit(";"), F.lit(1)), F.lit(""))

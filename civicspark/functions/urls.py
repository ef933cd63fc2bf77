"""URL work as Spark column expressions.

Everything here stays on the JVM. Splitting, normalising and the link policy
are plain string functions, so a projection over them keeps its whole-stage
code; only :func:`url_join` uses array functions (it has to walk dot segments).
The splitting rules are those of Python's ``urllib.parse``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicspark.functions.binding import let

# Scheme classes of the URL standard library the results follow.
SCHEMES_WITH_PARAMS = [
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp",
    "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel",
]
SCHEMES_RELATIVE = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https",
    "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn",
    "svn+ssh", "ws", "wss",
]
SCHEMES_WITH_NETLOC = [
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file",
    "mms", "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu",
    "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss",
    "itms-services",
]

# Default link policy.
DEFAULT_EXCLUDED_DIRECTORIES = [
    "calendar", "homepage_release_calendar", "about", "contact", "privacy",
    "terms", "core", "section", "full", "profiles",
]
DEFAULT_EXCLUDED_EXTENSIONS = [
    ".zip", ".pdf", ".doc", ".docx", ".ppt", ".pptx", ".png", ".jpg", ".jpeg",
    ".gif", ".csv", ".xml", ".json", ".txt",
]
DEFAULT_PATH_PREFIXES = ["statistics", "census"]
DOWNLOAD_MARKERS = [".xlsx", ".zip"]

_BLANKS = "".join(chr(c) for c in range(0x21))


def _one_of(schemes: Iterable[str]) -> str:
    return "(?i:" + "|".join(re.escape(s) for s in schemes if s) + "):"


# Each part is one regular expression over the whole text. Nesting column
# expressions instead would repeat the inner text in every outer branch.
_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"
_HEAD = rf"(?s)^(?:{_SCHEME})?+(?://[^/?#]*+)?+"
_NO_PARAMS_SCHEME = rf"^(?!{_one_of(SCHEMES_WITH_PARAMS)}){_SCHEME}"
_EMPTY_PARAMS = (
    rf"(?s)^(?!(?!{_one_of(SCHEMES_WITH_PARAMS)}){_SCHEME})((?:{_SCHEME})?+(?://[^/]*+)?+(?:.*/)?[^/;]*);$"
)
_IDLE_AUTHORITY = rf"^((?!{_one_of(SCHEMES_WITH_NETLOC)}){_SCHEME})?//(?=/(?!/)|$)"
# References without scheme, host, params and blanks to clean, whose query and fragment are not empty if they are there.
_PLAIN = rf"^(?!{_SCHEME}|//|[\x00-\x20])[^?#;\t\r\n]*+(?:\?[^#\t\r\n]++)?+(?:#[^\t\r\n]++)?+\z"
_PLAIN_HOSTED = r"^(?:https?:)?//[^/?#;\t\r\n]++(?:/[^?#;\t\r\n]*+)?+(?:\?[^#\t\r\n]++)?+(?:#[^\t\r\n]++)?+\z"
_MISSING_AUTHORITY = rf"^({_one_of(SCHEMES_WITH_NETLOC)})(?=/(?!/)|$)"


def _is_one_of(scheme: Column, schemes: Iterable[str]) -> Column:
    return scheme.rlike(rf"^(?:{'|'.join(re.escape(s) for s in schemes if s)})?$")


def _lit(value: str) -> Column:
    return F.lit(value)


def _clean(url: Column) -> Column:
    """``url`` without leading blanks and without tabs and line breaks."""
    return F.when(url.rlike(r"^[\x00-\x20]|[\t\r\n]"), F.ltrim(F.translate(url, "\t\r\n", ""), _lit(_BLANKS))).otherwise(url)


@dataclass(frozen=True)
class UrlParts:
    scheme: Column
    netloc: Column
    path: Column
    params: Column
    query: Column
    fragment: Column

    def as_struct(self) -> Column:
        return F.struct(*[getattr(self, f).alias(f) for f in self.__dataclass_fields__])


def parts_of(struct: Column) -> UrlParts:
    """Read back a struct written by :meth:`UrlParts.as_struct`."""
    return UrlParts(*[struct[f] for f in UrlParts.__dataclass_fields__])


def split_url(url: Column) -> UrlParts:
    """Scheme, netloc, path, params, query and fragment of ``url``."""
    text = _clean(url)
    whole_path = text.rlike(_NO_PARAMS_SCHEME)
    return UrlParts(
        scheme=F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)),
        netloc=netloc_of(url),
        path=path_of(url),
        params=F.when(whole_path, "").otherwise(
            F.regexp_extract(text, _HEAD + r"(?:[^?#]*/)?+[^/?#;]*;([^?#]*)", 1)
        ),
        query=F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1),
        fragment=F.regexp_extract(text, r"(?s)^[^#]*#(.*)$", 1),
    )


def netloc_of(url: Column) -> Column:
    return F.regexp_extract(_clean(url), rf"^(?:{_SCHEME})?//([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    """Path without params, query and fragment."""
    text = _clean(url)
    return F.when(text.rlike(_NO_PARAMS_SCHEME), F.regexp_extract(text, _HEAD + r"([^?#]*)", 1)).otherwise(
        F.regexp_extract(text, _HEAD + r"((?:[^?#]*/)?+[^/?#;]*)", 1)
    )


def unsplit_url(parts: UrlParts) -> Column:
    """The URL text of ``parts``; empty parts leave no separator behind."""
    local = F.when(parts.params == "", parts.path).otherwise(F.concat(parts.path, _lit(";"), parts.params))
    rooted = F.when((local == "") | local.startswith("/"), local).otherwise(F.concat(_lit("/"), local))
    bare_authority = (
        (parts.scheme != "")
        & _is_one_of(parts.scheme, SCHEMES_WITH_NETLOC)
        & ((local == "") | local.startswith("/"))
    )
    with_netloc = (
        F.when(parts.netloc != "", F.concat(_lit("//"), parts.netloc, rooted))
        .when(local.startswith("//") | bare_authority, F.concat(_lit("//"), local))
        .otherwise(local)
    )
    return F.concat(
        F.when(parts.scheme == "", "").otherwise(F.concat(parts.scheme, _lit(":"))),
        with_netloc,
        F.when(parts.query == "", "").otherwise(F.concat(_lit("?"), parts.query)),
        F.when(parts.fragment == "", "").otherwise(F.concat(_lit("#"), parts.fragment)),
    )


def percent_decode(text: Column) -> Column:
    """Decode ``%XX``; a ``+`` and a ``%`` without two hex digits stay as they are."""
    safe = F.replace(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"), _lit("+"), _lit("%2B"))
    return F.when(text.contains("%"), F.url_decode(safe)).otherwise(text)


def normalize_url(url: Column, decode: bool = True) -> Column:
    """Canonical text: decoded, query parts sorted, no fragment, no trailing ``/``, lower case.

    ``decode=False`` leaves percent escapes alone.
    """
    local = F.substring_index(_clean(percent_decode(url) if decode else url), "#", 1)
    start = F.substring_index(local, "?", 1)
    return _canonical(start, F.substr(local, F.length(start) + 2))


def _normalized_once(url: Column) -> Column:
    """:func:`normalize_url` for use in a lambda, where nothing else keeps a part from being worked out again."""
    return let(let(percent_decode(url), lambda text: F.substring_index(_clean(text), "#", 1)), lambda local: let(
        F.substring_index(local, "?", 1), lambda start: let(F.substr(local, F.length(start) + 2), lambda query: _canonical(start, query))
    ))


def _canonical(start: Column, query: Column) -> Column:
    """Canonical text of a URL up to its query, and the query."""
    # Most texts need none of the corrections; a test for one costs less than the correction.
    head = F.when(start.contains(";"), F.regexp_replace(start, _EMPTY_PARAMS, "$1")).otherwise(start)
    hosted = start.startswith("http://") | start.startswith("https://")
    head = F.when(hosted, head).otherwise(
        F.regexp_replace(F.regexp_replace(head, _IDLE_AUTHORITY, "$1"), _MISSING_AUTHORITY, "$1//")
    )
    ordered = F.when(query.contains("&"), F.array_join(F.sort_array(F.split(query, "&")), "&")).otherwise(query)
    marked = F.when(query == "", "").otherwise(F.regexp_replace(F.concat(_lit("?"), ordered), r"^\?$", ""))
    return F.lower(F.rtrim(F.concat(head, marked), _lit("/")))


def _resolve_dots(path: Column) -> Column:
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, segment: F.when(segment == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(segment == ".", done)
        .otherwise(F.array_append(done, segment)),
    )
    closed = F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(kept, _lit(""))).otherwise(kept)
    dotted = (path.contains("./") | path.rlike(r"\.$")) & path.rlike(r"(^|/)\.\.?(/|$)")
    return F.when(dotted, F.array_join(closed, "/")).otherwise(path)


def _merged(base_path: Column, path: Column) -> Column:
    """``path`` in the folder of ``base_path``."""
    folder = F.when(base_path == "", _lit("/")).otherwise(
        F.substr(base_path, F.lit(1), F.length(base_path) - F.length(basename(base_path)))
    )
    whole = F.concat(folder, path)
    return F.when(whole.contains("//"), F.regexp_replace(whole, "/+", "/")).otherwise(whole)


def _resolve(base: UrlParts, href: UrlParts, raw_href: Column) -> Column:
    scheme = F.when(href.scheme == "", base.scheme).otherwise(href.scheme)
    networked = _is_one_of(scheme, SCHEMES_WITH_NETLOC)
    netloc = F.when(networked, base.netloc).otherwise(href.netloc)
    unwalked = F.when(href.path.startswith("/"), href.path).otherwise(_merged(base.path, href.path))

    absolute = UrlParts(scheme, href.netloc, href.path, href.params, href.query, href.fragment)
    query = F.when(href.query == "", base.query).otherwise(href.query)
    same_document = UrlParts(scheme, netloc, base.path, base.params, query, href.fragment)

    def relative(walked: Column) -> Column:
        path = F.when(walked == "", _lit("/")).otherwise(walked)
        return unsplit_url(UrlParts(scheme, netloc, path, href.params, href.query, href.fragment))

    return (
        F.when((scheme != base.scheme) | ~_is_one_of(scheme, SCHEMES_RELATIVE), raw_href)
        .when((href.netloc != "") & networked, unsplit_url(absolute))
        .when((href.path == "") & (href.params == ""), unsplit_url(same_document))
        .otherwise(let(let(unwalked, _resolve_dots), relative))
    )


def _join(base: Column, base_parts: Column, href: Column) -> Column:
    joined = let(split_url(href).as_struct(), lambda h: _resolve(parts_of(base_parts), parts_of(h), href))
    # Most links are plain references on a web site; they need no splitting.
    on_web = base_parts["scheme"].isin("http", "https") & (base_parts["netloc"] != "")
    hosted = F.when(href.startswith("//"), F.concat(base_parts["scheme"], _lit(":"), href)).otherwise(href)
    plain = (
        F.when(base == "", href).when(href == "", base).when(~on_web, None)
        .when(href.rlike(_PLAIN), _join_plain(parts_of(base_parts), href)).when(href.rlike(_PLAIN_HOSTED), hosted)
    )
    return F.coalesce(plain, joined)


def _join_plain(base: UrlParts, href: Column) -> Column:
    """:func:`_resolve` for a reference that is ``_PLAIN``, on a page with a host."""
    site = F.concat(base.scheme, _lit("://"), base.netloc)
    page = F.concat(site, base.path, F.when(base.params == "", "").otherwise(F.concat(_lit(";"), base.params)))
    asked = F.concat(page, F.when(base.query == "", "").otherwise(F.concat(_lit("?"), base.query)))

    def from_path(path: Column) -> Column:
        rooted = lambda walked: F.concat(
            site, F.when(walked.startswith("/"), "").otherwise("/"), walked, F.substr(href, F.length(path) + 1)
        )
        unwalked = F.when(path.startswith("/"), path).otherwise(_merged(base.path, path))
        return let(let(unwalked, _resolve_dots), rooted)

    return (
        F.when(href.startswith("?"), F.concat(page, href)).when(href.startswith("#"), F.concat(asked, href))
        .otherwise(let(F.substring_index(F.substring_index(href, "#", 1), "?", 1), from_path))
    )


def url_join(base: Column, href: Column) -> Column:
    """Absolute URL of the reference ``href`` found on the page ``base``."""
    return let(split_url(base).as_struct(), lambda b: _join(base, b, href))


def resolve_links(base: Column, hrefs: Column, parts: Column | None = None) -> Column:
    """``array<struct<href, absolute, url>>``: the references ``hrefs`` of a page made absolute and canonical.

    Meant for ``inline``: the page address is split once, and a filter on the
    result is not pushed into the computation, which would repeat it. ``parts`` is
    ``split_url(base).as_struct()`` where a page's references come in many rows.
    """

    def link(href: Column, absolute: Column) -> Column:
        return F.struct(href.alias("href"), absolute.alias("absolute"), _normalized_once(absolute).alias("url"))

    def of_page(b: Column) -> Column:
        return F.transform(hrefs, lambda h: let(_join(base, b, h), lambda a: link(h, a)))

    return let(split_url(base).as_struct(), of_page) if parts is None else of_page(parts)


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def content_md5(content: Column) -> Column:
    return F.md5(content)


def basename(path: Column) -> Column:
    """Text after the last ``/``."""
    return F.substring_index(path, "/", -1)


def path_ext(url: Column) -> Column:
    """Extension of the last path segment with its dot; leading dots start no extension."""
    return F.regexp_extract(basename(path_of(url)), r"(?s)^\.*[^.].*?(\.[^.]*)$", 1)


def local_target(url: Column, folder: str, by_extension: bool = True) -> Column:
    """Where a download of ``url`` is stored below ``folder``."""
    name = basename(url)
    if not by_extension:
        return F.concat(_lit(folder + "/"), name)
    ext = path_ext(url)
    return F.concat(_lit(folder + "/"), ext, F.when(ext == "", "").otherwise("/"), name)


def _any(conditions: Iterable[Column]) -> Column:
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found


def not_excluded_ext(url: Column, extensions: Iterable[str] = DEFAULT_EXCLUDED_EXTENSIONS) -> Column:
    """The path extension, compared exactly, is not in ``extensions``."""
    extensions = list(extensions)
    return ~path_ext(url).isin(extensions) if extensions else F.lit(True)


def allowed_path(url: Column, prefixes: Iterable[str] = DEFAULT_PATH_PREFIXES) -> Column:
    """The path without outer slashes is empty or starts with one of ``prefixes``."""
    path = F.trim(path_of(url), _lit("/"))
    return (path == "") | _any(path.startswith(p) for p in prefixes)


def not_excluded_dir(url: Column, words: Iterable[str] = DEFAULT_EXCLUDED_DIRECTORIES) -> Column:
    """No deny word occurs anywhere in the URL text."""
    return ~_any(url.contains(w) for w in words)


def not_excluded_suffix(url: Column, extensions: Iterable[str] = DEFAULT_EXCLUDED_EXTENSIONS) -> Column:
    """The URL text, query included, ends with none of ``extensions``."""
    return ~_any(url.endswith(e) for e in extensions)


def downloadable(url: Column, markers: Iterable[str] = DOWNLOAD_MARKERS) -> Column:
    """One of ``markers`` occurs anywhere in the URL text."""
    return _any(url.contains(m) for m in markers)

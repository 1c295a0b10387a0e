"""Text functions that stay in the JVM: MIME types, HTML, sentences, tokens."""

from __future__ import annotations

import mimetypes
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.columns import as_column, let

WHITESPACE = " \t\n\r\f"
SENTENCE = r"(?s)\S.*?(?:[.!?]+(?:\s+|\z)|\z)"
TOKEN = r"\S+"

# Parts of a page that carry no document text.
DROPPED = (
    r"(?is)<!--.*?-->"
    r"|<head\b[^>]*>.*?</head\s*>"
    r"|<script\b[^>]*>.*?</script\s*>"
    r"|<style\b[^>]*>.*?</style\s*>"
    r"|<nav\b[^>]*>.*?</nav\s*>"
    r"|<noscript\b[^>]*>.*?</noscript\s*>"
    r"|<template\b[^>]*>.*?</template\s*>"
)

# (pattern, replacement) in order; "\x01" marks a heading until its level is known.
MARKUP = (
    (DROPPED, " "),
    (r"\s+", " "),
    (r"(?i)<h([1-6])\b[^>]*>", "\n\n\x01$1 "),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)<tr\b[^>]*>", "\n| "),
    (r"(?i)</t[dh]\s*>", " | "),
    (r"(?i)<br\b[^>]*>", "\n"),
    (
        r"(?i)</?(?:p|div|article|section|header|footer|main|aside|ul|ol|table|"
        r"blockquote|pre|form|body|html|h[1-6])\b[^>]*>",
        "\n\n",
    ),
    (r"</?[A-Za-z!][^>]*>", ""),
)

# A character reference: by decimal number, by hexadecimal number or by one of the names of HTML 4.
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});"
NO_BREAK_SPACE, REPLACEMENT = 0xA0, 0xFFFD

SPACING = ((r"[ \t\r\f]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"))

LOOKS_LIKE_HTML = r"(?i)<(?:!doctype html|html|head|body|article|section|div|p|h[1-6]|ul|ol|table)\b"


def mime_types() -> dict[str, str]:
    """Extension to MIME type, from the standard library's built-in table.

    Compound suffixes such as ``.tgz`` are resolved to the type of the file
    inside, so one lookup answers them too.
    """
    table = mimetypes.MimeTypes(filenames=())
    known = dict(table.types_map[True])
    for suffix in table.suffix_map:
        inner = table.guess_file_type("x" + suffix)[0]
        if inner is not None:
            known[suffix] = inner
    return known


def encoding_suffixes() -> list[str]:
    """Compression suffixes; the type is that of the name without them."""
    return sorted(mimetypes.MimeTypes(filenames=()).encodings_map)


URI = r"(?s)^[A-Za-z][A-Za-z0-9+.-]+:(?://[^/?#]*)?([^?#]*)"
EXTENSION = r"(?s)^\.*[^.].*(\.[^.]*)$"


def mime_type(path: Column | str) -> Column:
    """MIME type by file extension, NULL if unknown. URIs lose host and query."""
    path = as_column(path)
    local = F.when(path.rlike(URI), F.regexp_extract(path, URI, 1)).otherwise(path)
    name = F.regexp_extract(local, r"([^/]*)$", 1)
    last = F.regexp_extract(name, EXTENSION, 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(last))
    packed = last.isin(encoding_suffixes())
    extension = F.lower(F.when(packed, F.regexp_extract(stem, EXTENSION, 1)).otherwise(last))
    known = F.create_map(*[F.lit(x) for pair in sorted(mime_types().items()) for x in pair])
    return F.try_element_at(known, extension)


def decode_references(text: Column | str) -> Column:
    """Character references replaced by their characters, each once; unknown names stay.

    A no-break space becomes a blank, a number that is no character the replacement character.
    """
    names = {**name2codepoint, "apos": ord("'")}
    known = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])

    def number(hit: Column) -> Column:
        digits = F.regexp_extract(hit, "^&#[xX]?([0-9A-Fa-f]+);", 1)
        sixteen = F.conv(digits, 16, 10).cast("int")
        return F.when(hit.rlike("^&#[xX]"), sixteen).otherwise(digits.cast("int"))

    def point(hit: Column) -> Column:
        by_name = F.try_element_at(known, F.substring(hit, F.lit(2), F.length(hit) - 2))
        return F.when(hit.startswith("&#"), number(hit)).otherwise(by_name)

    def character(code: Column) -> Column:
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        whole = F.when(bad, REPLACEMENT).when(code == NO_BREAK_SPACE, ord(" ")).otherwise(code)
        return F.decode(F.unhex(F.lpad(F.hex(whole), 8, "0")), "UTF-32")

    def decoded(hit: Column) -> Column:
        return let(point(hit), lambda code: F.when(code.isNull(), hit).otherwise(character(code)))

    def woven(text: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
        pieces = F.zip_with(
            F.split(text, REFERENCE, -1),
            hits,
            lambda gap, hit: F.concat(gap, F.when(hit.isNull(), "").otherwise(decoded(hit))),
        )
        return F.array_join(pieces, "")

    text = as_column(text)
    return let(text, lambda t: F.when(t.rlike(REFERENCE), woven(t)).otherwise(t))


def html_to_text(html: Column | str) -> Column:
    """HTML to markdown-flavoured text; NULL stays NULL.

    An ordered list of regular expressions rather than a parser, so unclosed
    tags do no harm and nothing leaves the JVM.
    """
    text = as_column(html)
    for pattern, replacement in MARKUP:
        text = F.regexp_replace(text, pattern, replacement)
    for level in range(1, 7):
        text = F.replace(text, F.lit(f"\x01{level}"), F.lit("#" * level))
    text = decode_references(text)
    for pattern, replacement in SPACING:
        text = F.regexp_replace(text, pattern, replacement)
    return F.trim(text, F.lit(WHITESPACE))


def parse_document(content: Column | str) -> Column:
    """Document bytes to text; NULL for anything that is not readable HTML."""
    text = F.try_validate_utf8(as_column(content).cast("string"))
    return F.when(text.rlike(LOOKS_LIKE_HTML), html_to_text(text))


def why_unreadable(content: Column | str) -> Column:
    """Why :func:`parse_document` gives NULL; NULL where it gives a text."""
    content = as_column(content)
    text = F.try_validate_utf8(content.cast("string"))
    return (
        F.when(content.isNull(), "no content")
        .when(text.isNull(), "not UTF-8")
        .when(~text.rlike(LOOKS_LIKE_HTML), "not HTML")
    )


def sentence_array(text: Column | str) -> Column:
    """Sentences in order. One ends at ``.!?`` before a blank or the end."""
    found = F.regexp_extract_all(as_column(text), F.lit(SENTENCE), F.lit(0))
    return F.transform(found, lambda s: F.rtrim(s, F.lit(WHITESPACE)))


def first_sentence(text: Column | str) -> Column:
    return F.rtrim(F.regexp_extract(as_column(text), SENTENCE, 0), F.lit(WHITESPACE))


def sentences(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per sentence: the ``keep`` columns, ``sentence_ix``, ``sentence``."""
    return df.select(*keep, F.posexplode(sentence_array(text)).alias("sentence_ix", "sentence"))


def token_array(text: Column | str) -> Column:
    """Lower-case runs of non-blank characters."""
    return F.filter(F.split(F.lower(as_column(text)), r"\s+"), lambda t: t != "")


def token_count(text: Column | str) -> Column:
    return F.regexp_count(as_column(text), F.lit(TOKEN)).cast("bigint")

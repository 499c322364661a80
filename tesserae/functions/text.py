"""Column functions over text: white space, tokens, sentences, cleaning, identity. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space (also U+001C to U+001F), tokens and sentence ends.
SPACE = r"\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACES = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# What \s is in SQL.
ASCII_SPACES = "\t\n\f\r "
ASCII_LIST_ITEM = r"^([-*+]|\d+[.)、])[\t\n\f\r ]"
# SPACE inside of brackets; visible ASCII characters are told first.
_SPACE = rf"[^!-~]&&[{SPACE}]"
TOKEN = rf"[\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9_]+|[^{SPACE}]"
SENTENCE_ENDS = "。！？!?；;."
OPEN_ENDED = "。！？.:：;；)）`"
LINE_BREAK = r"[[^ -~]&&[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]](?:(?<=\r)\n)?"
LIST_ITEM = r"^([-*+]|\d+[.)、])[" + SPACE + "]+"
PAGE_NUMBER = rf"^[{SPACE}]*(第[{SPACE}]*)?\d+[{SPACE}]*(页|/[{SPACE}]*\d+)?[{SPACE}]*$"
# Runs of blanks that aren't one space already.
BLANKS = r"[ \t](?:[ \t]+|(?<=\t))"
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def let(value: Column, body) -> Column:
    """``body`` of a value that is made once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def token_count(text: Column) -> Column:
    """CJK characters, words of letters, digits and underscores, and any other visible character. Null counts as empty. What ``TOKEN``
    matches is counted without taking it out: a word with the white space behind it becomes one character, other white space goes."""
    marks = F.regexp_replace(F.regexp_replace(text, r"\w++\s*+", "x"), rf"[{_SPACE}]++", "")
    return F.coalesce(F.length(marks), F.lit(0))


def lines(text: Column, breaks: str = LINE_BREAK, spaces: str = SPACES) -> Column:
    """Lines, stripped, without blank ones."""
    return F.filter(F.transform(F.split(text, breaks), lambda x: F.btrim(x, F.lit(spaces))), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Cut after each sentence end or newline."""
    parts = F.split(text, rf"(?<=[{SENTENCE_ENDS}\n])[{SPACE}]*")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def sentences_spaced(text: Column) -> Column:
    """Cut where white space follows a sentence end, and after newlines: for text whose dots may be inside words."""
    parts = F.split(text, rf"[{_SPACE}](?:(?<=\n)|(?<=[{SENTENCE_ENDS}][\s\S]))[{SPACE}]*")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def clean_characters(text: Column) -> Column:
    """No-break spaces become spaces; zero-width spaces and control characters go; runs of blanks and of newlines shrink."""
    text = F.replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), F.lit("\u200b"), F.lit(""))
    text = F.regexp_replace(text, r"[\x00-\x1f&&[^\t\n\r]]", "")
    text = F.regexp_replace(text, BLANKS, " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def clean_markdown(text: Column, element_type: Column, kept: tuple[str, ...] = ("code", "table", "list", "blockquote", "html")) -> Column:
    """Elements whose layout matters lose only long gaps; others also extra blanks and HTML comments."""
    text = strip(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n"))
    loose = F.regexp_replace(F.regexp_replace(text, BLANKS, " "), r"\n{3,}", "\n\n")
    loose = strip(F.regexp_replace(loose, r"(?s)<!--.*?-->", ""))
    return F.when(element_type.isin(*kept), F.regexp_replace(text, r"\n{4,}", "\n\n\n")).otherwise(loose)


def merge_broken_lines(text: Column, breaks: str = LINE_BREAK, spaces: str = SPACES, item: str = LIST_ITEM) -> Column:
    """Joins a line to the one before it, with nothing between, unless that one ends a statement or this one is a list item. ``breaks``,
    ``spaces`` and ``item`` may say otherwise what parts lines, what is stripped, and what a list item begins with."""
    found = lines(text, breaks, spaces)

    def joined(all_lines: Column) -> Column:
        pieces = F.transform(
            all_lines,
            lambda line, i: F.when(i == 0, line).otherwise(
                F.concat(F.when(F.get(all_lines, i - 1).rlike(rf"[{OPEN_ENDED}]\z") | line.rlike(item), "\n").otherwise(""), line)
            ),
        )
        return F.array_join(pieces, "")

    return F.element_at(F.transform(F.array(found), joined), 1)


def is_page_number(text: Column) -> Column:
    return text.rlike(PAGE_NUMBER)


def is_list_item(text: Column) -> Column:
    return text.rlike(rf"^[{SPACE}]*([-*+]|\d+[.)、])[{SPACE}]+")


def detect_language(text: Column) -> Column:
    """``zh`` where CJK characters outnumber Latin letters, else ``en``."""
    return F.when(F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]")) > F.regexp_count(text, F.lit("[A-Za-z]")), "zh").otherwise("en")


def uuid5_url(name: Column) -> Column:
    """The name-based UUID (version 5) in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "utf-8")))
    variant = F.substr(F.lit("89ab"), F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def chunk_id(owner: Column, index: Column, digest: Column) -> Column:
    """``owner`` is the file id, or the file name where a format has no file id."""
    return uuid5_url(F.concat_ws(":", owner, index.cast("string"), digest))


def safe_file_name(name: Column) -> Column:
    """The base name with characters that file systems refuse replaced; null where nothing usable is left."""
    base = F.element_at(F.split(F.translate(name, "\\", "/"), "/"), -1)
    clean = strip(F.regexp_replace(base, r'[<>:"/\\|?*\x00-\x1f]', "_"))
    return F.when(~clean.isin("", ".", ".."), clean)


def preview(text: Column, limit: int = 220) -> Column:
    """White space collapsed, cut to ``limit`` characters."""
    flat = strip(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{SPACE}]+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"[{SPACE}]+", " "))

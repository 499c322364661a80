"""Heading context of ordered blocks. Arrays here hold one document, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import SPACE, let, strip

# How headings are numbered.
# What a marker begins with; the dear look behind is taken only at digits and letters A. A marker holds no beginning but its own.
BEGINS = rf"(?=[Aa0-9])(?<![^{SPACE}])[Aa]?\d"
MARKER = rf"{BEGINS}+(?:\.\d+)*\.?[{SPACE}]*[;；、.]?[{SPACE}]*"
NUMBERED = rf"^[{SPACE}]*(\d+(?:\.\d+)*)[.、{SPACE}]+"
CHAPTER = rf"^[{SPACE}]*第[一二三四五六七八九十百千万0-9]+[章节篇部分]"
_PATHS = "array<array<struct<level:int,title:string>>>"


def marker_level(text: Column) -> Column:
    """Depth of a leading number plus one, 6 at most; null without one. "A1.2" counts as "1.2"."""
    number = F.regexp_extract(strip(text), r"^[Aa]?(\d+(?:\.\d+)*)", 1)
    return F.when(number != "", F.least(F.size(F.split(number, r"\.")) + 1, F.lit(6)))


def positional_level(text: Column, given: Column) -> Column:
    return F.greatest(F.coalesce(marker_level(text), F.nullif(given, F.lit(0)), F.lit(1)), F.lit(1))


def word_level(text: Column, style: Column, outline: Column) -> Column:
    """Level of a word processor paragraph that is a heading: by style, outline, number or chapter word; else null."""
    named = F.lower(style).startswith("heading") | style.startswith("标题")
    digits = F.regexp_extract(style, r"(\d+)", 1)
    number = F.regexp_extract(text, NUMBERED, 1)
    return (
        F.when(named, F.when(digits != "", digits.cast("int")).otherwise(1))
        .when(outline.isNotNull(), outline + 1)
        .when(number != "", F.least(F.size(F.split(number, r"\.")), F.lit(6)))
        .when(text.rlike(CHAPTER), 1)
    )


def split_numbered(text: Column) -> Column:
    """A heading that holds several numbers becomes as many headings; one with fewer stays. What stands before the first
    number of several is lost."""
    parts = lambda own: F.filter(F.transform(own, strip), lambda x: x != "")
    # As lambda variables the text and its parts are made once; columns that are named twice would be made twice.
    return let(text, lambda whole: let(_numbered(whole), lambda own: F.when(F.size(own) > 1, parts(own)).otherwise(F.array(whole))))


def _numbered(text: Column) -> Column:
    """The pieces of the text that begin with a marker, one for each. What follows a marker is passed in strides to where another may begin."""
    return F.regexp_extract_all(strip(text), F.lit(rf"{MARKER}(?:(?!{BEGINS})[\s\S][^Aa0-9]*+)*+"), F.lit(0))


def positional_paths(headings: Column) -> Column:
    """For each of ``headings`` (array of struct<level, title>) its path of titles, where a heading of level n keeps the first
    n - 1 entries of the path before it."""
    push = lambda path, h: F.concat(F.slice(path, F.lit(1), F.least(h["level"] - 1, F.size(path))), F.array(F.struct(h["level"].alias("level"), h["title"].alias("title"))))
    return _fold(headings, push)


def levelled_paths(headings: Column) -> Column:
    """The same, where a heading removes all entries of its own or a deeper level."""
    push = lambda path, h: F.concat(F.filter(path, lambda p: p["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["title"].alias("title"))))
    return _fold(headings, push)


def _fold(headings: Column, push) -> Column:
    start = F.array().cast(_PATHS)
    empty = F.array().cast("array<struct<level:int,title:string>>")
    step = lambda done, h: F.concat(done, F.array(push(F.coalesce(F.try_element_at(done, F.lit(-1)), empty), h)))
    return F.aggregate(headings, start, step)


def positional_depth(rows: DataFrame, document: str, order: str, level: str) -> DataFrame:
    """``depth`` of each heading row by windows alone: for tables whose documents are too long for one array. The depth is
    the heading's ordinal plus the least of (level - ordinal) so far, or of zero."""
    w = Window.partitionBy(document).orderBy(order)
    ordinal = F.row_number().over(w)
    return rows.withColumn("_i", ordinal).withColumn("depth", F.col("_i") + F.least(F.lit(0), F.min(F.col(level) - F.col("_i")).over(w))).drop("_i")

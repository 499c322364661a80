"""Column functions that turn tables (HTML, pipe rows, arrays of cells) into text to embed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import LINE_BREAK, SPACE, collapse, lines, strip

# Entities decoded natively, caption forms, and the column names that make a two-column row an explanation.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
CAPTION = (
    r"(?iU)^(table|tab\.?|tbl\.?)\s*[\w.-]+[\s:：.-]+.+",
    r"(?U)^[表附]表?\s*[\w.-]+[\s:：、.-]+.+",
    r"(?U)^\([a-zA-Z0-9]+\)\s+\S+",
)
EXPLANATIONS = ("原因", "含义", "说明", "描述", "功能", "用途", "解释", "处理方式")
STOPS = "。.;；"


def unescape(html: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, html)


def html_rows(html: Column) -> Column:
    """A line for each row, cells apart by " | "."""
    text = unescape(html)
    text = F.regexp_replace(text, rf"(?i)<[{SPACE}]*/[{SPACE}]*t[dh][{SPACE}]*>[{SPACE}]*<[{SPACE}]*t[dh][^>]*>", " | ")
    text = F.regexp_replace(text, rf"(?i)<[{SPACE}]*/[{SPACE}]*tr[{SPACE}]*>[{SPACE}]*<[{SPACE}]*tr[^>]*>", "\n")
    text = F.regexp_replace(text, "<[^>]+>", "")
    edge = lambda x: F.regexp_replace(F.regexp_replace(x, rf"[{SPACE}]+", " "), r"^[ |]+|[ |]+$", "")
    return F.array_join(F.filter(F.transform(F.split(text, LINE_BREAK), edge), lambda x: x != ""), "\n")


def html_flat(html: Column) -> Column:
    """One line; every cell end becomes " | "."""
    text = F.regexp_replace(html, rf"(?i)<[{SPACE}]*/[{SPACE}]*tr[{SPACE}]*>", "\n")
    text = F.regexp_replace(text, rf"(?i)<[{SPACE}]*/[{SPACE}]*(td|th)[{SPACE}]*>", " | ")
    return collapse(F.regexp_replace(text, "<[^>]+>", ""))


def table_text(table: Column) -> Column:
    """Pipe tables stay, HTML becomes rows."""
    return F.when(strip(table).startswith("|"), strip(table)).otherwise(html_rows(table))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is made once however often ``body`` reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_caption(line: Column, collapsed: bool = False) -> Column:
    """A short line such as "Table 1: results". ``collapsed``: white space in it is collapsed first."""

    def fits(line: Column) -> Column:
        pipes = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
        return (line != "") & (F.length(line) <= 220) & (pipes < 2) & reduce(lambda a, b: a | b, (line.rlike(p) for p in CAPTION))

    return _let(collapse(line) if collapsed else strip(line), fits)


def leading_captions(text: Column) -> Column:
    """``captions`` (the caption lines at the top) and ``body`` (the lines after them)."""

    def cut(found: Column, n: Column) -> Column:
        return F.struct(F.slice(found, F.lit(1), n).alias("captions"), F.array_join(F.slice(found, n + 1, F.size(found)), "\n").alias("body"))

    def split(found: Column) -> Column:
        # The lines are looked at as far as the first that is no caption.
        n = F.aggregate(found, F.struct(F.lit(0).alias("n"), F.lit(True).alias("top")), lambda a, x: F.when(a["top"], F.when(is_caption(x), F.struct((a["n"] + 1).alias("n"), F.lit(True).alias("top"))).otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("top")))).otherwise(a), lambda a: a["n"])
        return _let(n, lambda k: cut(found, k))

    return _let(lines(text), split)


def described_table(captions: Column, body: Column, notes: Column) -> Column:
    """Captions, body and notes as paragraphs; captions found at the top of the body join the others, each kept once."""

    def told(top: Column) -> Column:
        parts = F.concat(
            F.transform(F.array_distinct(F.concat(_lines_of(captions), top["captions"])), lambda c: F.concat(F.lit("Table caption: "), c)),
            F.filter(F.array(top["body"]), lambda x: x != ""),
            F.transform(F.array_distinct(_lines_of(notes)), lambda c: F.concat(F.lit("Table note: "), c)),
        )
        return strip(F.array_join(parts, "\n\n"))

    return _let(leading_captions(F.coalesce(_let(body, table_text), F.lit(""))), told)


def _lines_of(values: Column) -> Column:
    return F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(lines(v), F.array().cast("array<string>"))))


def _trimmed(cell: Column) -> Column:
    return F.regexp_replace(strip(cell), rf"[{STOPS}]+$", "")


def rows_as_records(rows: Column) -> Column:
    """Each row after the header as a sentence "表格第i行记录: 列为值，…。". Blank cells are left out before names are paired."""
    filled = F.transform(rows, lambda r: F.filter(F.transform(r, strip), lambda c: c != ""))

    def tell(table: Column) -> Column:
        header = F.get(table, F.lit(0))

        def record(row: Column, i: Column) -> Column:
            pairs = F.zip_with(header, row, lambda h, c: F.concat(h, F.lit("为"), F.regexp_replace(c, rf"[{STOPS}]+$", "")))
            return F.concat(F.lit("表格第"), (i + 1).cast("string"), F.lit("行记录: "), F.array_join(F.when(F.size(row) == F.size(header), pairs).otherwise(row), "，"), F.lit("。"))

        return F.array_join(F.transform(F.slice(table, F.lit(2), F.greatest(F.size(table) - 1, F.lit(0))), record), "\n")

    return F.element_at(F.transform(F.array(filled), tell), 1)


def rows_as_lines(rows: Column) -> Column:
    """Rows with cells apart by " | "; rows without content are left out."""
    told = F.transform(rows, lambda r: F.array_join(F.filter(F.transform(r, strip), lambda c: c != ""), " | "))
    return F.array_join(F.filter(told, lambda x: x != ""), "\n")


def word_table_sentences(rows: Column) -> Column:
    """Sentences for a table of a word processor file: two columns read "K的H是V。" (or "K表示V。" under an explaining header),
    others list "name为value" pairs; a single row lists its values."""
    filled = F.filter(F.transform(rows, lambda r: F.transform(r, strip)), lambda r: F.exists(r, lambda c: c != ""))

    def tell(table: Column) -> Column:
        alone = F.size(table) == 1
        header = F.when(alone, F.array().cast("array<string>")).otherwise(F.get(table, F.lit(0)))
        body = F.when(alone, table).otherwise(F.slice(table, F.lit(2), F.greatest(F.size(table) - 1, F.lit(0))))

        def sentence(row: Column, i: Column) -> Column:
            name = lambda k, default: F.coalesce(F.nullif(F.get(header, F.lit(k)), F.lit("")), F.lit(default))
            key, value = _trimmed(F.get(row, F.lit(0))), _trimmed(F.get(row, F.lit(1)))
            two = F.when(name(1, "说明").isin(*EXPLANATIONS), F.concat(name(0, "字段"), key, F.lit("表示"), value, F.lit("。"))).otherwise(F.concat(name(0, "字段"), key, F.lit("的"), name(1, "说明"), F.lit("是"), value, F.lit("。")))
            pairs = F.filter(F.zip_with(header, row, lambda h, c: F.when((h != "") & (c != ""), F.concat(h, F.lit("为"), _trimmed(c)))), lambda p: p.isNotNull())
            values = F.transform(F.filter(row, lambda c: c != ""), _trimmed)
            named = (F.size(header) > 0) & (F.size(header) == F.size(row))
            record = F.concat(F.lit("表格第"), (i + 1).cast("string"), F.lit("行记录: "), F.array_join(F.when(named, pairs).otherwise(values), "，"), F.lit("。"))
            return F.when((F.size(row) == 2) & (F.size(header) >= 2), two).otherwise(record)

        return F.array_join(F.transform(body, sentence), "\n")

    return F.element_at(F.transform(F.array(filled), tell), 1)


def markdown_table(rows: Column) -> Column:
    """Rows as a Markdown table, padded to the widest, with a rule under the first."""

    def tell(table: Column) -> Column:
        width = F.array_max(F.transform(table, lambda r: F.size(r)))
        wide = lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))
        row = lambda r: F.concat(F.lit("| "), F.array_join(wide(r), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        return F.array_join(F.concat(F.array(row(F.get(table, F.lit(0))), rule), F.transform(F.slice(table, F.lit(2), F.greatest(F.size(table) - 1, F.lit(0))), row)), "\n")

    return F.when(F.size(rows) > 0, F.element_at(F.transform(F.array(rows), tell), 1)).otherwise("")


def unit_box(box: Column) -> Column:
    """A bounding box in units of the page, corners in order: coordinates beyond 1.5 are thousandths."""
    scaled = F.transform(box, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.array_max(F.transform(box, F.abs)) > 1.5, x / 1000.0).otherwise(x.cast("double")))))
    at = lambda i: F.get(scaled, F.lit(i))
    ordered = F.array(F.least(at(0), at(2)), F.least(at(1), at(3)), F.greatest(at(0), at(2)), F.greatest(at(1), at(3)))
    return F.when(F.size(box) == 4, ordered)

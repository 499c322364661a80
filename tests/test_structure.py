"""Headings, cleaning, packing and Markdown, against plain loops where these are short."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import clean, headings
from tesserae.operators.chunk import Budget, markdown_chunks, pack, pdf_chunks, word_chunks
from tesserae.sources import items, markdown
from tesserae.sources.files import items_of


def paths(spark, levels, fold):
    row = spark.createDataFrame([([(v, str(i)) for i, v in enumerate(levels)],)], "h array<struct<level:int,title:string>>")
    return [[e["title"] for e in p] for p in row.select(fold(F.col("h")).alias("p")).first()["p"]]


def test_heading_stacks(spark):
    levels = [3, 1, 2, 2, 4]
    assert [len(p) for p in paths(spark, levels, headings.positional_paths)] == [1, 1, 2, 2, 3]
    assert [[levels[int(i)] for i in p] for p in paths(spark, levels, headings.levelled_paths)] == [[3], [1], [1, 2], [1, 2], [1, 2, 4]]


def test_positional_depth_equals_the_fold(spark):
    rng = random.Random(3)
    rows = [(d, i, rng.randint(1, 6)) for d in range(40) for i in range(rng.randint(1, 25))]
    df = spark.createDataFrame(rows, "d int, i int, level int")
    got = {(r["d"], r["i"]): r["depth"] for r in headings.positional_depth(df, "d", "i", "level").collect()}
    for d in range(40):
        depth = 0
        for _, i, level in (r for r in rows if r[0] == d):
            depth = min(depth, level - 1) + 1
            assert got[d, i] == depth


def test_split_numbered(spark):
    split = lambda t: spark.range(1).select(headings.split_numbered(F.lit(t)).alias("x")).first()["x"]
    assert split("1. Intro 1.1 Scope") == ["1. Intro", "1.1 Scope"]
    assert split("lost 1 One 2 Two") == ["1 One", "2 Two"]
    assert split("Plain") == ["Plain"]


def blocks(spark, contents, kind="paragraph"):
    return spark.createDataFrame([("f", i, kind, c, None, None) for i, c in enumerate(contents)], "file_id string, block_idx int, block_type string, content string, page_number int, heading_level int")


def test_clean_blocks(spark):
    got = [r["content"] for r in clean.clean_blocks(blocks(spark, ["A", "A", "12", "A", "B", "A"])).orderBy("block_idx").collect()]
    assert got == ["B"]  # "A" occurs four times: noise
    got = [r["content"] for r in clean.clean_blocks(blocks(spark, ["A" * 121, "A" * 121, "12", "A" * 121, "B", "A" * 121])).orderBy("block_idx").collect()]
    assert got == ["A" * 121, "B", "A" * 121]
    assert clean.repeated_noise(blocks(spark, ["x", "x"])).count() == 0
    assert [r["noise"] for r in clean.repeated_noise(blocks(spark, ["x", " x", "x "])).collect()] == ["x"]


def plain_pack(units, prefix, budget, at_target):
    def carry(held):
        kept, tokens = [], 0
        for u in reversed(held):
            if not u[2]:
                continue
            if kept and tokens + u[1] > budget.overlap:
                break
            kept.insert(0, u)
            tokens += u[1]
        return kept

    done, held = [], []
    for u in units:
        tokens = prefix + sum(x[1] for x in held)
        if held and (tokens + u[1] > budget.most or at_target and tokens >= budget.target):
            done.append([x[0] for x in held])
            held = carry(held)
        if u[3] and u[1] > budget.most:
            done.append([u[0]])
            held = []
            continue
        held.append(u)
    return done + ([[x[0] for x in held]] if held else [])


@pytest.mark.parametrize("at_target", [False, True])
def test_pack_equals_a_loop(spark, at_target):
    rng, budget = random.Random(5), Budget(30, 40, 10)
    cases = [[(i, rng.choice([1, 3, 5, 9, 20, 45]), rng.random() < 0.8, rng.random() < 0.5) for i in range(rng.randint(0, 40))] for _ in range(150)]
    df = spark.createDataFrame([(n, c, n % 7) for n, c in enumerate(cases)], "n int, u array<struct<i:int,t:int,keep:boolean,alone:boolean>>, p int")
    for r in df.select("n", "p", pack(F.col("u"), F.col("p"), budget, at_target).alias("x")).collect():
        assert r["x"] == plain_pack(cases[r["n"]], r["p"], budget, at_target)


def test_pdf_chunks(spark):
    rows = [("f", 0, "heading", "1 One", 1, None), ("f", 1, "paragraph", "Alpha beta.", 1, None), ("f", 2, "heading", "1.1 Sub", 2, None), ("f", 3, "table", "| a |", 2, None), ("f", 4, "paragraph", "Gamma.", 3, None), ("f", 5, "heading", "2 Two", 3, None)]
    got = pdf_chunks(spark.createDataFrame(rows, "file_id string, block_idx int, block_type string, content string, page_number int, heading_level int")).orderBy("chunk_index").collect()
    assert [r["text"] for r in got] == ["1 One\n\nAlpha beta.", "1 One\n1.1 Sub\n\n| a |\nGamma."]
    assert [(r["chapter"], r["section"], r["page_numbers"], r["block_types"]) for r in got] == [("1 One", "", [1], ["paragraph"]), ("1 One", "1.1 Sub", [2, 3], ["paragraph", "table"])]
    assert [r["chunk_index"] for r in got] == [0, 1]


def test_word_chunks(spark):
    rows = [("f", "a.docx", 0, "paragraph", None, "Lead."), ("f", "a.docx", 1, "heading", 1, "H"), ("f", "a.docx", 2, "paragraph", None, "One. " * 500)]
    elements = spark.createDataFrame(rows, "file_id string, file_name string, element_idx int, element_type string, level int, content string")
    got = word_chunks(clean.clean_word(elements)).orderBy("chunk_index").collect()
    assert got[0]["text"] == "Lead." and got[0]["chapter"] == "" and got[1]["text"].startswith("H\n\nOne.")
    assert all(r["token_count"] <= 801 for r in got) and len(got) == 3


TEXT = """# Title

Para one
goes on.

## Part

Table 1: numbers

| a | b |
|---|---|
| 1 | 2 |

- x
  - y
3. z

```python
code
```

> quote

![i](u)

<div>h</div>
"""


def test_markdown(spark):
    found = markdown.elements(spark.createDataFrame([("f", TEXT), ("e", ""), ("n", None)], "file_id string, text string")).orderBy("element_idx").collect()
    assert [(r["element_type"], r["content"]) for r in found] == [
        ("heading", "Title"), ("paragraph", "Para one\ngoes on."), ("heading", "Part"), ("paragraph", "Table 1: numbers"), ("table", "Table caption: Table 1: numbers\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"),
        ("list", "- x\n  - y"), ("list", "3. z"), ("code", "```python\ncode\n```"), ("blockquote", "> quote"), ("image", "![i](u)"), ("html", "<div>h</div>"),
    ]
    assert found[4]["heading_path"] == ["Title", "Part"] and (found[4]["line_start"], found[4]["line_end"]) == (10, 12)


def test_markdown_chunks(spark):
    rows = markdown.elements(spark.createDataFrame([("f", TEXT)], "file_id string, text string"))
    got = markdown_chunks(clean.clean_markdown_elements(rows)).orderBy("chunk_index").collect()
    assert [r["heading"] for r in got] == ["Title", "Title > Part"]
    assert got[0]["text"] == "# Title\n\nPara one\ngoes on." and got[1]["text"].startswith("# Title\n## Part\n\nTable 1")
    assert got[0]["line_start"] == 1 and got[0]["line_end"] == 4


def test_line_blocks(spark):
    text = "# H\ntext\nmore\n|a|\n|b|\n```\ncode\n```\n- item\n```\nopen"
    got = markdown.line_blocks(spark.createDataFrame([("f", text)], "file_id string, text string")).orderBy("block_idx").collect()
    assert [(r["block_type"], r["content"]) for r in got] == [("heading", "H"), ("paragraph", "text\nmore"), ("table", "|a|"), ("table", "|b|"), ("code", "```\ncode\n```"), ("list", "- item"), ("paragraph", "```\nopen")]


def test_items(spark):
    text = '{"content_list": [{"type": "title", "text": "T", "page_idx": 0}, {"blocks": [{"type": "text", "text": "1.2 Deep", "text_level": 1, "page_number": 5, "page_idx": 4}, {"text": " "}]}, {"type": "table", "table_body": "<table><tr><td>a</td><td>b</td></tr></table>", "table_caption": ["C"], "page": "x"}, {"type": "image", "img_caption": ["x", " "]}]}'
    assert len(items_of(text)) == 5
    got = items.blocks(items.items(spark.createDataFrame([("f", text), ("bad", "{")], "file_id string, json string"))).orderBy("block_idx").collect()
    assert [(r["block_type"], r["content"], r["page_number"], r["heading_level"]) for r in got] == [("title", "T", 1, None), ("heading", "1.2 Deep", 6, 3), ("table", "Table caption: C\n\na | b", None, None), ("image", "x", None, None)]

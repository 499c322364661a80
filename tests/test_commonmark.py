"""Blocks of Markdown: containers, lazy lines, definitions, kinds of HTML and of code, and where blocks end."""

import random
import time

import pyarrow as pa
import pytest

from tesserae.sources import markdown
from tesserae.sources.commonmark import cells, read
from tesserae.sources.markdown import parse


def shown(text):
    return [(e["element_type"], e["content"], e["line_start"], e["line_end"]) for e in parse(text)]


@pytest.mark.parametrize("text, expected", [
    # Quotes: nested, with lazy lines, with what is no paragraph.
    ("> a\n> > b\nlazy\n\nafter", [("blockquote", "> a\n> b\n> lazy", 1, 3), ("paragraph", "after", 5, 5)]),
    ("> ```\nx\n", [("paragraph", "x", 2, 2)]),
    ("> # H\n> - i\n>   j\n> 1. k", [("blockquote", "> H\n> i\n> j\n> k", 1, 4)]),
    ("> a\n\n> b", [("blockquote", "> a", 1, 1), ("blockquote", "> b", 3, 3)]),
    ("> a\n---", [("blockquote", "> a", 1, 1)]),
    (">     code\n> | a | b |\n> |---|---|\n> | c | d |", [("blockquote", "> a\n> b\n> c\n> d", 1, 4)]),
    (">\n> x", [("blockquote", "> x", 1, 2)]),
    # Lists: numbers, kinds, nesting, paragraphs and code in items, blank lines.
    ("- a\n- b\n\n- c\n\n\npara", [("list", "- a\n- b\n- c", 1, 6), ("paragraph", "para", 7, 7)]),
    ("7. a\n8. b\n1) c", [("list", "7. a\n8. b", 1, 2), ("list", "1. c", 3, 3)]),
    ("- a\n  - b\n    - c\n- d", [("list", "- a\n  - b\n    - c\n- d", 1, 4)]),
    ("- a\nlazy\n\n  second\n\n      code\n- b", [("list", "- a\nlazy\n- b", 1, 7)]),
    ("- - a\n- b", [("list", "- a\n- b", 1, 2)]),
    ("1. > q\n   > r\n2. ```\n   x\n   ```\n3. # H", [("list", "1. q\nr\n3. H", 1, 6)]),
    ("-\n  a\n-\n\n  b", [("list", "- a", 1, 4), ("paragraph", "b", 5, 5)]),
    ("para\n2. no list\n- list", [("paragraph", "para\n2. no list", 1, 2), ("list", "- list", 3, 3)]),
    ("- a\n\n      \n- b\n", [("list", "- a\n- b", 1, 4)]),
    ("* a\n+ b\n- c", [("list", "- a", 1, 1), ("list", "- b", 2, 2), ("list", "- c", 3, 3)]),
    ("- a\n    1. x\n    2. y\n\n  more\n***\nz", [("list", "- a\n  1. x\n  2. y", 1, 5), ("paragraph", "z", 7, 7)]),
    ("0. zero", [("list", "0. zero", 1, 1)]),
    # Headings.
    ("# a #\n## \n####### no\n#no", [("heading", "a", 1, 1), ("heading", "", 2, 2), ("paragraph", "####### no\n#no", 3, 4)]),
    ("two\nlines\n===\nx\n-", [("heading", "two\nlines", 1, 3), ("heading", "x", 4, 5)]),
    ("> a\n===", [("blockquote", "> a\n> ===", 1, 2)]),
    # Code.
    ("~~~ py x\n```\n~~~~\nafter", [("code", "```py\n```\n```", 1, 3), ("paragraph", "after", 4, 4)]),
    ("  ```\n   a\n  b\n c", [("code", "```\n a\nb\nc\n```", 1, 4)]),
    ("``` a`b\nx", [("paragraph", "``` a`b\nx", 1, 2)]),
    ("    a\n\n\t b\n\n\nx", [("code", "```\na\n\n b\n```", 1, 3), ("paragraph", "x", 6, 6)]),
    ("p\n    not code", [("paragraph", "p\n    not code", 1, 2)]),
    # Definitions of links.
    ("[a]: /u \"t\"\n[b]:\n<v>\ntext [a]", [("paragraph", "text [a]", 4, 4)]),
    ("[a]: /u\n===", [("paragraph", "===", 2, 2)]),
    ("[a]: /u 'no\ntitle\n\n[c]: x\n\np\n[d]: y", [("paragraph", "[a]: /u 'no\ntitle", 1, 2), ("paragraph", "p\n[d]: y", 6, 7)]),
    ("[a]: /u\n[a]: /v 'many\nlines'\n# H", [("heading", "H", 4, 4)]),
    # HTML: the seven kinds.
    ("<script>\n\nx</script> y\nz", [("html", "<script>\n\nx</script> y", 1, 3), ("paragraph", "z", 4, 4)]),
    ("<!-- a\n\nb -->\n<?x\n?>\n<!DOCTYPE html>\n<![CDATA[\n]]>", [("html", "<!-- a\n\nb -->", 1, 3), ("html", "<?x\n?>", 4, 5), ("html", "<!DOCTYPE html>", 6, 6), ("html", "<![CDATA[\n]]>", 7, 8)]),
    ("<div>\n&amp; *a*\n\nb", [("html", "<div>\n& *a*", 1, 2), ("paragraph", "b", 4, 4)]),
    ("<x-y a='1' b>\nc\n\np\n<i>\n<div>", [("html", "<x-y a='1' b>\nc", 1, 2), ("paragraph", "p\n<i>", 4, 5), ("html", "<div>", 6, 6)]),
    ("<i> text", [("paragraph", "<i> text", 1, 1)]),
    # Tables.
    ("a | b\n:-|-:\nc \\| d | e | f\ng\n\nh", [("table", "| a | b |\n| --- | --- |\n| c | d | e |\n| g |  |", 1, 4), ("paragraph", "h", 6, 6)]),
    ("p\n| a |\n| - |\n> q", [("paragraph", "p", 1, 1), ("table", "| a |\n| --- |", 2, 3), ("blockquote", "> q", 4, 4)]),
    ("a | b\n---\nc", [("heading", "a | b", 1, 2), ("paragraph", "c", 3, 3)]),
    # Rules, images, tabs, nothing.
    ("***\n- - -\n![a](b)\n\n_ _ _", [("image", "![a](b)", 3, 3)]),
    ("-\ta\n\n\tb\n>\tc", [("list", "- a", 1, 3), ("blockquote", "> c", 4, 4)]),
    ("", []), ("\n \n", []),
])
def test_blocks(text, expected):
    assert shown(text) == expected


def test_headings_lead_what_follows_but_not_those_in_quotes():
    got = list(parse("# A\n> # B\n\n## C\n- # D\n\nx"))
    assert [e["heading_path"] for e in got] == [["A"], ["A"], ["A", "C"], ["A", "C"], ["A", "C"]] and got[-1]["heading_levels"] == [1, 2]


def test_any_text_can_be_read():
    rng = random.Random(2)
    marks = ["> ", "- ", "1. ", "  ", "    ", "\t", "```", "~~~", "#", " ", "a", "|", "-", "=", "<div>", "<!--", "-->", "[a]: b", "\n", "\n", "\n\n", "***", "\\"]
    for _ in range(3000):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(1, 30)))
        blocks = read(text)
        ends = [(b.start, b.end) for b in blocks]
        assert all(a < b for a, b in ends) and all(a[1] <= b[0] for a, b in zip(ends, ends[1:])), text
        list(parse(text))


def test_long_texts_take_time_in_proportion():
    for unit in ("> a\n", "- a\n", "[a]: b \"\n", "| a | b |\n", "<a \"", "*a\n_b ", "1. x\n\n", "`" * 3 + "x\n"):
        began = time.time()
        list(parse(unit * (200_000 // len(unit))))
        assert time.time() - began < 5, unit


def test_cells():
    assert cells(" | a | b \\| c |") == ["a", "b | c"] and cells("a|") == ["a"] and cells("x") == ["x"]


def test_workers_hold_a_bounded_part_of_a_batch(monkeypatch):
    """elements are sent as they come up, not when all texts of a batch are read."""
    monkeypatch.setattr(markdown, "GATHERED", 1000)
    texts = ["# t\n\n" + "word " * 50 + f"\n\n- {i}" for i in range(60)] + [None, "", "long " * 400]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(texts)], names=["file_id", "text"])
    made = list(markdown._element_batches(iter([batch])))
    assert len(made) > 10 and max(sum(map(len, b.column("content").to_pylist())) for b in made) <= 3000
    found = [(r["file_id"], r["element_idx"], r["content"]) for b in made for r in b.to_pylist()]
    assert found == [(str(i), n, e["content"]) for i, t in enumerate(texts) for n, e in enumerate(markdown.parse(t or ""))]

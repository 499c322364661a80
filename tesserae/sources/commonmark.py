"""The block structure of Markdown: CommonMark's containers and leaves, with pipe tables.

Lines are taken one by one against a stack of open containers (quotes, lists, items), each of which must find its own mark or indent
on a line to stay open; what is left of the line may open new blocks, or goes on in the open leaf. A paragraph also takes
lines whose containers' marks are missing. Link reference definitions leave the paragraph that they start. Work is linear in the
lines, times the containers that are open at once. Inline marks stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_ATX = re.compile(r"(#{1,6})(?:[ \t]+|$)(.*)")
_FENCE = re.compile(r"(`{3,}|~{3,})(.*)$", re.S)
_ITEM = re.compile(r"([-*+]|(\d{1,9})([.)]))(?=[ \t]|$)")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_DELIMITER = re.compile(r"(?!-[ \t])\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_TITLE = r'"(?:[^"\\]|\\.)*"|' + r"'(?:[^'\\]|\\.)*'" + r"|\((?:[^()\\]|\\.)*\)"
_REFERENCE = re.compile(rf"[ \t]*\[(?=[^\]]*[^\]\s])(?:[^\[\]\\]|\\.)+\]:[ \t]*\n?[ \t]*(?:<(?:[^<>\\\n]|\\.)*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:{_TITLE}))?[ \t]*(?:\n|\Z)", re.S)
# Elements that start a block of HTML.
_BLOCKS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html "
    "iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
_ATTRIBUTE = r"\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?"
#: What starts a block of HTML, and what ends it: None for a blank line. The last can't interrupt a paragraph.
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?=\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(rf"</?(?:{'|'.join(_BLOCKS.split())})(?=\s|/?>|$)", re.I), None),
    (re.compile(rf"(?:<[A-Za-z][A-Za-z0-9-]*(?:{_ATTRIBUTE})*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"), None),
]


@dataclass
class Block:
    """``start`` and ``end``: the first line, and one past the last. ``lines``: the text of a leaf, or the rows of a table."""

    kind: str  # document quote list item; paragraph heading code html table rule
    start: int
    end: int = 0
    children: list[Block] = field(default_factory=list)
    lines: list = field(default_factory=list)
    level: int = 0
    info: str = ""
    indent: int = 0  # of a fence, or of the content of an item
    mark: str = ""  # of a fence, or the kind of a list
    number: int | None = None  # the first of an ordered list
    until: re.Pattern | None = None  # what ends HTML

    @property
    def text(self) -> str:
        return "\n".join(self.lines).strip()


def _indent(text: str, column: int) -> tuple[int, int]:
    """Columns of the white space that the text starts with, and its characters."""
    width = n = 0
    for n, c in enumerate(text):
        if c == "\t":
            width += 4 - (column + width) % 4
        elif c == " ":
            width += 1
        else:
            return width, n
    return width, len(text)


def _cut(text: str, column: int, columns: int) -> tuple[str, int]:
    """The text without up to so many columns of white space; what is left of a tab are spaces."""
    end = column + columns
    n = 0
    while n < len(text) and column < end and text[n] in " \t":
        column += 4 - column % 4 if text[n] == "\t" else 1
        n += 1
    return (" " * (column - end) + text[n:], end) if column > end else (text[n:], column)


def cells(line: str) -> list[str]:
    body = line.strip()
    body = body[1:] if body.startswith("|") else body
    body = body[:-1] if body.endswith("|") and not body.endswith("\\|") else body
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", body)]


class _Reader:
    def __init__(self) -> None:
        self.document = Block("document", 0)
        self.open = [self.document]
        self.leaf: Block | None = None

    # Closing and opening.

    def close_leaf(self, at: int) -> None:
        leaf, self.leaf = self.leaf, None
        if leaf is None:
            return
        leaf.end = leaf.end or at
        if leaf.kind == "paragraph":
            self.without_references(leaf)
            if not leaf.lines:
                self.open[-1].children.remove(leaf)
        elif leaf.kind == "code" and not leaf.mark:
            while not leaf.lines[-1].strip():
                leaf.lines.pop()
            leaf.end = leaf.start + len(leaf.lines)

    def without_references(self, leaf: Block) -> None:
        if not leaf.lines or not leaf.lines[0].lstrip().startswith("["):
            return
        text, at = "\n".join(leaf.lines), 0
        while m := _REFERENCE.match(text, at):
            at = m.end()
        gone = text.count("\n", 0, at) if at < len(text) else len(leaf.lines)
        leaf.lines, leaf.start = leaf.lines[gone:], leaf.start + gone

    def close_to(self, depth: int, at: int) -> None:
        """Closes the leaf, and all but ``depth`` containers."""
        self.close_leaf(at)
        while len(self.open) > depth:
            self.open.pop().end = at

    def add(self, block: Block, leaf: bool = False) -> Block:
        """Adds to the innermost container that may hold it."""
        if self.open[-1].kind == "list" and block.kind != "item":
            self.open.pop().end = block.start
        self.open[-1].children.append(block)
        if leaf:
            self.leaf = block
        elif block.kind in ("quote", "list", "item"):
            self.open.append(block)
        return block

    # Lines.

    def line(self, at: int, text: str) -> None:
        column, depth = 0, 1
        for block in self.open[1:]:
            width, n = _indent(text, column)
            if block.kind == "quote":
                if width > 3 or text[n : n + 1] != ">":
                    break
                text, column = _cut(text[n + 1 :], column + width + 1, 1)
            elif block.kind == "item":
                if n == len(text):
                    if not block.children and self.leaf is None:
                        break
                elif width >= block.indent:
                    text, column = _cut(text, column, block.indent)
                else:
                    break
            depth += 1
        inside = depth == len(self.open)
        blank = not text.strip()
        if inside and self.leaf and self.goes_on(at, text, column, blank):
            return
        started = False
        while not blank and (step := self.starts(at, text, column, depth, inside)):
            started = True
            if step is True:
                return
            text, column = step
            depth = len(self.open)
            inside, blank = True, not text.strip()
        if blank:
            if started:
                return
            if self.leaf and self.leaf.kind == "paragraph" or not inside:
                self.close_leaf(at)
            if not inside and any(b.kind == "quote" for b in self.open[depth:]):
                self.close_to(depth + next(i for i, b in enumerate(self.open[depth:]) if b.kind == "quote"), at)
            elif not inside:
                self.close_to(depth, at)
            return
        if self.leaf and self.leaf.kind == "paragraph" and not started:
            self.leaf.lines.append(text)  # also where marks of containers are missing
            return
        if not started:
            self.close_to(depth, at)
        self.add(Block("paragraph", at, lines=[text]), leaf=True)

    def goes_on(self, at: int, text: str, column: int, blank: bool) -> bool:
        """Whether the open leaf takes the line, all of whose containers are open."""
        leaf = self.leaf
        width, n = _indent(text, column)
        if leaf.kind == "code" and leaf.mark:
            if width < 4 and re.fullmatch(rf"{leaf.mark[0]}{{{len(leaf.mark)},}}[ \t]*", text[n:]):
                leaf.end = at + 1
                self.leaf = None
            else:
                leaf.lines.append(_cut(text, column, leaf.indent)[0])
            return True
        if leaf.kind == "code":
            if blank or width >= 4:
                leaf.lines.append(_cut(text, column, 4)[0])
                return True
        elif leaf.kind == "html":
            if leaf.until is None and blank:
                self.close_leaf(at)
                return True
            leaf.lines.append(text)
            if leaf.until and leaf.until.search(text):
                self.close_leaf(at + 1)
            return True
        elif leaf.kind == "table" and not blank and width < 4 and not self.interrupts(text[n:]):
            row = cells(text)[: len(leaf.lines[0])]
            leaf.lines.append(row + [""] * (len(leaf.lines[0]) - len(row)))
            return True
        if leaf.kind in ("code", "table"):
            self.close_leaf(at)
        return False

    def interrupts(self, rest: str) -> bool:
        """Whether what stands after the indent ends a table."""
        return bool(rest[:1] == ">" or _ATX.match(rest) or _FENCE.match(rest) or _RULE.match(rest) or any(start.match(rest) for start, _ in _HTML[:-1]) or (m := _ITEM.match(rest)) and m[2] in (None, "1") and rest[m.end() :].strip())

    def starts(self, at: int, text: str, column: int, depth: int, inside: bool) -> bool | tuple[str, int] | None:
        """Opens the block that starts here: True if it takes the rest of the line, else what is left of the text and its column."""
        width, n = _indent(text, column)
        rest = text[n:]
        paragraph = self.leaf is not None and self.leaf.kind == "paragraph"
        if width >= 4:
            if paragraph:
                return None
            self.close_to(depth, at)
            return bool(self.add(Block("code", at, lines=[_cut(text, column, 4)[0]]), leaf=True))
        if rest[0] == ">":
            self.close_to(depth, at)
            self.add(Block("quote", at))
            return _cut(rest[1:], column + width + 1, 1)
        if m := _ATX.match(rest):
            self.close_to(depth, at)
            title = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", m[2].rstrip())
            return bool(self.add(Block("heading", at, at + 1, lines=[title], level=len(m[1]))))
        if (m := _FENCE.match(rest)) and not (m[1][0] == "`" and "`" in m[2]):
            self.close_to(depth, at)
            return bool(self.add(Block("code", at, info=m[2].strip(), mark=m[1], indent=width), leaf=True))
        for i, (start, until) in enumerate(_HTML):
            if start.match(rest) and not (paragraph and inside and i == len(_HTML) - 1):
                self.close_to(depth, at)
                self.add(Block("html", at, lines=[text], until=until), leaf=True)
                if until and until.search(text):
                    self.close_leaf(at + 1)
                return True
        if paragraph and inside and (m := _SETEXT.match(rest)):
            self.without_references(self.leaf)
            if self.leaf.lines:
                block, self.leaf = self.leaf, None
                block.kind, block.level, block.end = "heading", 1 if m[1][0] == "=" else 2, at + 1
                return True
            self.close_leaf(at)  # it held definitions only
            paragraph = False
        if paragraph and inside and self.table(at, rest):
            return True
        if _RULE.match(rest):
            self.close_to(depth, at)
            return bool(self.add(Block("rule", at, at + 1)))
        m = _ITEM.match(rest)
        after = rest[m.end() :] if m else ""
        if m and not (paragraph and inside and self.open[depth - 1].kind != "list" and (not after.strip() or m[2] not in (None, "1"))):
            self.close_to(depth, at)
            kind = m[3] or m[1]
            if self.open[-1].kind == "list" and self.open[-1].mark != kind:
                self.open.pop().end = at
            if self.open[-1].kind != "list":
                self.add(Block("list", at, mark=kind, number=None if m[2] is None else int(m[2])))
            inner = _indent(after, column + width + m.end())[0]
            gap = 1 if not after.strip() or inner > 4 else inner
            self.add(Block("item", at, indent=width + m.end() + gap))
            return _cut(after, column + width + m.end(), gap)
        return None

    def table(self, at: int, rest: str) -> bool:
        """Whether the line is the one below the head of a table, which is the paragraph's last line."""
        head = self.leaf.lines[-1]
        if "|" not in head or not _DELIMITER.match(rest) or len(cells(head)) != len(cells(rest)):
            return False
        before = self.leaf
        before.lines.pop()
        if before.lines:
            self.close_leaf(at - 1)
        else:
            self.open[-1].children.remove(before)
        self.add(Block("table", at - 1, lines=[cells(head)]), leaf=True)
        return True


def read(text: str) -> list[Block]:
    """The blocks of a text outside any container. A list ends where the next block starts: blank lines after it are its own."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    reader = _Reader()
    for at, line in enumerate(lines):
        reader.line(at, line)
    reader.close_to(1, len(lines))
    blocks = reader.document.children
    for block, following in zip(blocks, [*blocks[1:], None]):
        if block.kind == "list":
            block.end = len(lines) if following is None else _first_text(lines, block.end, following.start)
    return blocks


def _first_text(lines: list[str], at: int, stop: int) -> int:
    """The first line from ``at`` on that isn't blank."""
    while at < stop and not lines[at].strip():
        at += 1
    return at


def inlines(block: Block) -> Iterator[str]:
    """Texts with inline marks in a block, in order: paragraphs, headings and cells."""
    if block.kind in ("paragraph", "heading"):
        yield block.text
    elif block.kind == "table":
        for row in block.lines:
            yield from row
    for child in block.children:
        yield from inlines(child)


def rendered_list(block: Block) -> str:
    """The first text of each item after its mark, by two spaces for each list around its own. An item whose own text comes first in
    an inner list is that list's."""
    out: list[str] = []

    def walk(node: Block, depth: int, mark: list[str]) -> None:
        if node.kind == "list":
            for i, item in enumerate(node.children):
                mark[:] = ["-" if node.number is None else f"{node.number + i}."]
                for child in item.children:
                    walk(child, depth + 1, mark)
        elif node.kind in ("paragraph", "heading", "table"):
            for text in inlines(node):
                if mark:
                    out.append("  " * (depth - 1) + f"{mark.pop()} {text}")
        else:
            for child in node.children:
                walk(child, depth, mark)

    walk(block, 0, [])
    return "\n".join(out).strip()


def quoted(block: Block) -> str:
    return "\n".join(f"> {line}" for text in inlines(block) for line in text.splitlines() if line.strip()).strip()

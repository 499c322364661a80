"""Main text of web pages, by removal of site templates.

Every page is parsed once to hash its element subtrees (tag, class, id, text and the hashes of the children). Spark
counts, per host, on how many unlike pages each hash occurs: pages with one main text are one page, so copies of a page don't
make its text a template. Subtrees on at least ``MIN_PAGES`` unlike pages and a ``SHARE`` of the host's are that site's template.
A second pass deletes them and writes out the blocks of what is left: of the page's ``article`` (or ``main``) if it has one, else
of its body.

Only blocks can be part of the template, and inside the article only boxes (``div``, ``section``, lists, ...): never headings,
paragraphs, list items, table cells by themselves, nor what holds an ``h1``. A box with text outside of links, inside the article,
must have less than half of the article's text, and the pages that share it must be unlike in their headings too, which
near copies of a page are not.

What a page says only once can't be found by recurrence. So what HTML itself marks as not being the article goes as well:
elements that aren't shown or aren't text, ``nav``, ``aside``, ``footer``, ``form``, ``header`` outside of the article, the ARIA roles of
these, and elements with a class or id that names an advert, notice, sidebar, share bar or reader comments: inside the article
by that word alone, outside of it also by one that starts or ends so. Such a name never removes an element that holds the article, a
``main`` or an ``h1``. An ``article`` that is named a comment is no article where there is another. ``marks=False`` leaves all this
out but for what isn't shown.

Defined results: a null or empty page has the empty text; pages without a host are a host of their own; unclosed and
misnested elements end where an ancestor does (a block ends an open paragraph); a page cut off in a tag ends there. From a tag whose
quotes never close on, tags end at the next ``>``. Columns other than the three that are named aren't looked at. A page takes time in
proportion to its length, however broken.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.wordhash import tidy
from tesserae.operators.skew import lookup_join
from tesserae.session import stored, text_batches

MIN_PAGES = 3
SHARE = 0.1

# Elements of HTML by what they are.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg math object noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_UNSEEN = frozenset("head button select input label canvas audio video map datalist option optgroup".split()) | _RAW
_OTHER = frozenset("nav aside footer form menu dialog fieldset".split())
_BOXES = frozenset("aside center details dir div dl fieldset figure footer form header menu nav ol section table ul".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
_WORDS = "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice notices popup modal overlay sidebar navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments respond replies share sharing social related newsletter subscribe subscription widget pagination pager".split()
#: A class or id that is one of these words, or starts or ends with one and a dash: not as a part that says where it is missing or next to.
_NAMED = re.compile(rf"(?:(?:{'|'.join(_WORDS)})(?:[-_].*)?|(?!(?:no|not|has|have|with|without|is|hide|non|after|before|show)[-_]).*[-_](?:{'|'.join(_WORDS)}))")
_NAMES = frozenset(_WORDS)
_COMMENT = frozenset("comment comments reply replies".split())
_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_REST = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"\s+")


class _Element:
    __slots__ = ("tag", "unseen", "marked", "named", "comment", "children", "key", "digest", "inside", "size", "prose", "heads")

    def __init__(self, tag: str, unseen: bool, marked: bool, named: bool, comment: bool, key: str, inside: bool):
        self.tag, self.unseen, self.marked, self.named, self.comment, self.key, self.inside = tag, unseen, marked, named, comment, key, inside
        self.children: list[_Element | str] = []
        self.digest = 0
        self.size = 0  # characters of text
        self.prose = False  # has text outside of links
        self.heads = tag in ("article", "main", "h1") and not comment  # holds what must stay


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), htmllib.unescape(value.strip("\"'")) if value else "")
    return found


def _kind(tag: str, attributes: dict[str, str], inside: bool) -> tuple[bool, bool, bool, bool]:
    """Whether an element isn't shown or isn't text; whether HTML marks it as something else than the article; whether its names do; and whether
    it is an ``article`` that is named a comment."""
    unseen, marked = tag in _UNSEEN, tag in _OTHER or tag == "header" and not inside
    if not attributes:
        return unseen, marked, False, False
    unseen = unseen or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    marked = marked or attributes.get("role", "").lower() in _ROLES
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    if tag == "article":
        return unseen, marked, False, not _COMMENT.isdisjoint(names)
    return unseen, marked, tag not in ("html", "body", "main") and (not _NAMES.isdisjoint(names) if inside else any(_NAMED.fullmatch(n) for n in names)), False


def parse(page: str) -> _Element:
    """The page's tree, with subtree hashes."""
    root = _Element("#", False, False, False, False, "#", False)
    stack = [root]
    #: For each open element the depth of the innermost block and of the innermost list or item around it, itself included; open tags by name.
    blocks, lists, opened = [0], [0], Counter()

    def close(depth: int) -> None:
        while len(stack) > depth:
            e = stack.pop()
            blocks.pop()
            lists.pop()
            opened[e.tag] -= 1
            for c in e.children:
                if type(c) is str:
                    e.size += len(c.strip())
                    e.prose = e.prose or e.tag != "a" and not c.isspace()
                elif not c.unseen:
                    e.size += c.size
                    e.prose = e.prose or c.prose and e.tag != "a"
                    e.heads = e.heads or c.heads
            e.digest = xxhash.xxh64_intdigest("\x00".join([e.key, *(c if type(c) is str else f"\x01{c.digest}" for c in e.children)])) >> 1

    at, n, quotes = 0, len(page), True
    while at < n:
        m = _OPEN.search(page, at)
        start = m.start() if m else n
        if start > at:
            stack[-1].children.append(page[at:start])
        if m is None:
            break
        at = m.end()
        slash, tag = m.groups()
        if tag is None:
            end = page.find("-->", start + 2) + 2 if m[0] == "<!--" else page.find(">", at)
            if end < at - 1:
                break  # a comment or declaration that never ends
            at = end + 1
            continue
        # Once the quotes of a tag aren't closed, quotes no longer count: else each tag after it would be looked for to the page's end.
        rest = _REST.match(page, at) if quotes else None
        if rest:
            text, at = rest[1], rest.end()
        else:
            quotes = False
            end = page.find(">", at)
            if end < 0:
                break
            text, at = page[at:end], end + 1
        tag = tag.lower()
        if slash:
            if tag not in _VOID and opened[tag]:
                close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag))
            continue
        if tag in _BLOCK:
            if tag == "li" and stack[lists[-1]].tag == "li":
                close(lists[-1])
            if stack[blocks[-1]].tag == "p":  # a block ends an open paragraph, and the inline elements in it
                close(blocks[-1])
        attributes = _attributes(text) if text and text.strip(" /\n\t\r") else {}
        inside = stack[-1].inside or tag in ("article", "main") or attributes.get("role") == "main"
        e = _Element(tag, *_kind(tag, attributes, stack[-1].inside), f"{tag}|{attributes.get('class', '')}|{attributes.get('id', '')}", inside)
        stack[-1].children.append(e)
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?:\s[^>]*)?>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        depth = len(stack)
        stack.append(e)
        opened[tag] += 1
        blocks.append(depth if tag in _BLOCK else blocks[-1])
        lists.append(depth if tag in ("li", "ul", "ol", "menu") else lists[-1])
    close(0)
    return root


def _bounded(e: _Element, whole: int) -> bool:
    """Whether an element may be part of a template, in an article of ``whole`` characters (0 outside of one)."""
    if e.heads or e.tag in ("html", "body", "br"):
        return False
    return e.tag in (_BOXES if e.inside else _BLOCK) and (not e.inside or not e.prose or 2 * e.size < whole)


def template_candidates(root: _Element) -> dict[int, bool]:
    """Hashes of the subtrees that may be a site's template, and whether they are text inside of an article."""
    found: dict[int, bool] = {}
    todo = [(c, 0) for c in root.children]
    while todo:
        e, whole = todo.pop()
        if type(e) is str or e.unseen:
            continue
        if not whole and e.inside:
            whole = e.size
        if _bounded(e, whole):
            found[e.digest] = found.get(e.digest, False) or e.inside and e.prose
        todo.extend((c, whole) for c in e.children)
    return found


def heading(root: _Element) -> str:
    """The text of the article's first heading, or else of the first ``h1``."""
    todo: list = [root]
    first = ""
    while todo:
        e = todo.pop()
        if type(e) is str or e.unseen:
            continue
        if e.tag in ("h1", "h2", "h3") and (e.inside or e.tag == "h1"):
            if e.inside:
                return main_text(e)
            first = first or main_text(e)
        todo.extend(reversed(e.children))
    return first


def main_text(root: _Element, template: frozenset[int] | set[int] = frozenset(), marks: bool = True) -> str:
    """Blocks of the article in page order, one a line."""
    blocks: list[str] = []
    words: list[str] = []

    def end() -> None:
        if words:
            text = _SPACE.sub(" ", htmllib.unescape("".join(words))).strip()
            if text:
                blocks.append(text)
            words.clear()

    def gone(e: _Element, whole: int) -> bool:
        return e.unseen or marks and (e.marked or e.named and not e.heads or e.comment and whole > 0) or e.digest in template and _bounded(e, whole)

    def articles(e: _Element, tags: tuple[str, ...]) -> Iterator[_Element]:
        todo = [e]
        while todo:
            x = todo.pop()
            if type(x) is str or gone(x, 0):
                continue
            if x.tag in tags:
                yield x
            else:
                todo.extend(reversed(x.children))

    def walk(top: _Element) -> None:
        whole = top.size if top.inside else 0
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif type(x) is str:
                words.append(x)
            elif x.tag == "br":
                words.append(" ")
            elif x is top or not gone(x, whole):
                block = x.tag in _BLOCK
                if block:
                    end()
                    todo.append(None)
                elif x.tag in ("td", "th"):
                    words.append(" ")
                todo.extend(reversed(x.children))
        end()

    for tops in (list(articles(root, ("article",))), list(articles(root, ("main",))), [root]):
        tops = [t for t in tops if not (marks and t.comment)] or tops
        if tops:
            for top in tops:
                walk(top)
            break
    return "\n".join(blocks)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """``host``, ``pages`` and ``template``, the hashes of subtrees on at least ``min_pages`` unlike pages and a ``share`` of the
    host's; ``pages`` are all of its pages. A host has at most 1/``share`` times as many of these as one of its pages has subtrees, on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, hashes, texts, heads = [], [], [], []
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                root = parse(page.as_py() or "")
                found = template_candidates(root)
                found.pop(0, None)
                text, head = (xxhash.xxh64_intdigest(x) >> 1 for x in (main_text(root), heading(root)))
                hosts += [h] * (len(found) + 1)
                hashes += [0, *found]  # 0 stands for the page
                texts += [text] * (len(found) + 1)
                heads += [None, *(head if inside else None for inside in found.values())]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (hashes, texts, heads))], names=["host", "hash", "text", "head"])

    seen = pages.select("host", "html").mapInArrow(tidy(run), "host string, hash long, text long, head long").groupBy("host", "hash", "text", "head").agg(F.count("*").alias("copies"))
    # A subtree inside of an article counts the headings it occurs with, if they are fewer than the texts.
    texts = seen.groupBy("host", "hash", "text").agg(F.sum("copies").alias("copies")).groupBy("host", "hash").agg(F.count("*").alias("n"), F.sum("copies").alias("rows"))
    heads = seen.filter("head is not null").groupBy("host", "hash", "head").agg(F.count("*").alias("_")).groupBy("host", "hash").agg(F.count("*").alias("m"))
    counted = texts.filter((F.col("hash") == 0) | (F.col("n") >= min_pages)).join(heads, ["host", "hash"], "left").withColumn("n", F.least("n", F.coalesce("m", "n"))).drop("m")
    kept = stored(counted.filter((F.col("hash") == 0) | (F.col("n") >= min_pages)), "subtrees")
    hosts = kept.filter("hash = 0").select("host", F.col("n").alias("unlike"), F.col("rows").alias("pages"), F.col("rows").alias("weight"))
    common = lookup_join(kept.filter("hash <> 0").drop("rows"), hosts, "host", "weight", spread=F.col("hash")).filter(F.col("n") >= share * F.col("unlike"))
    return common.groupBy("host").agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list("hash")).alias("template"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE, marks: bool = True) -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars``, a row for each row of ``pages``."""
    text_batches(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), host(F.col(url)).alias("host"), F.col(html).cast("string").alias("html"))
    templates = stored(site_templates(rows, min_pages, share), "templates")
    joined = lookup_join(rows, templates, "host", "pages", spread=F.coalesce(F.xxhash64("key", "url"), F.lit(0)), rows=templates.count())
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, frozenset[int]] = {}
        for batch in batches:
            texts = []
            for page, template in zip(batch.column(2), batch.column(3).to_pylist()):
                name = tuple(template or ())
                if name not in known:
                    if len(known) > 256:
                        known.clear()
                    known[name] = frozenset(name)
                texts.append(main_text(parse(page.as_py() or ""), known[name], marks))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    return joined.select("key", "url", "html", "template").mapInArrow(tidy(run), f"key {kind}, url string, text string, n_chars long").withColumnRenamed("key", key)

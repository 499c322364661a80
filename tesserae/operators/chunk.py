"""Heading-aware, token-bounded chunks with overlap. One exchange by document; packing is a fold over the document's units, in a worker that sees their token counts only.

A chunk is opened, filled while its tokens stay within ``most``, and closed when the next unit would not fit; the next
begins with the units at the end of the last that make up the overlap (always one, if any may overlap). The unit that
didn't fit is then added without another check, so a chunk may exceed ``most``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import chunk_id, content_hash, let, sentences, sentences_spaced, strip, token_count
from tesserae.operators.headings import marker_level, positional_level, positional_paths, split_numbered


@dataclass(frozen=True)
class Budget:
    """Tokens a chunk aims at, may hold, and shares with the one before. Zeros stand for the defaults."""

    target: int = 650
    most: int = 800
    overlap: int = 100

    def __post_init__(self) -> None:
        for name, default in (("target", 650), ("most", 800), ("overlap", 100)):
            object.__setattr__(self, name, getattr(self, name) or default)
        if self.target > self.most:
            raise ValueError("target tokens must not exceed the most tokens")


def pack_units(tokens: Sequence[int], keep: Sequence[bool], alone: Sequence[bool], prefix: int, budget: Budget, flush_at_target: bool = False) -> list[list[int]]:
    """Numbers of the units of each chunk. ``keep``: a unit may be carried over; ``alone``: it makes a chunk by itself when it exceeds the budget."""
    done: list[list[int]] = []
    held: list[int] = []
    total = prefix
    for i, t in enumerate(tokens):
        if held and (total + t > budget.most or flush_at_target and total >= budget.target):
            done.append(held)
            kept, shared = [], 0
            for k in reversed(held):  # units that may be carried, while their tokens fit; the first always does
                if not keep[k]:
                    continue
                if kept and shared + tokens[k] > budget.overlap:
                    break
                kept.append(k)
                shared += tokens[k]
            held, total = kept[::-1], prefix + shared
        if alone[i] and t > budget.most:
            done.append([i])
            held, total = [], prefix
        else:
            held.append(i)
            total += t
    return [*done, held] if held else done


def pack(units: Column, prefix_tokens: Column, budget: Budget, flush_at_target: bool = False) -> Column:
    """Arrays of unit numbers, one per chunk, from an array of structs with ``t``, ``keep`` and ``alone``: tokens, and as of ``pack_units``.
    The fold is sequential and its state grows, so it is linear in a worker, not in an expression; only numbers are sent there."""

    def chunks(units: Sequence[int], prefix: int) -> list[list[int]]:
        return pack_units([u >> 2 for u in units], [u & 2 > 0 for u in units], [u & 1 > 0 for u in units], prefix, budget, flush_at_target)

    @F.pandas_udf("array<array<int>>")
    def packed(units: pd.Series, prefix: pd.Series) -> pd.Series:
        return pd.Series([chunks(u.tolist(), int(p)) for u, p in zip(units, prefix)])

    # One number a unit. What isn't deterministic is computed once, where it stands, and not again inside of what reads it.
    light = F.transform(units, lambda u: u["t"].cast("long") * 4 + u["keep"].cast("long") * 2 + u["alone"].cast("long"))
    return packed.asNondeterministic()(light, prefix_tokens.cast("int"))


def _sections(documents: DataFrame, blocks: str, heading: tuple[str, ...]) -> DataFrame:
    """A row for each section of each document: its path of titles and its blocks without the heading."""
    is_heading = lambda b: b["type"].isin(*heading)
    at = F.filter(F.transform(F.col(blocks), lambda b, i: F.when(is_heading(b), i + 1)), lambda x: x.isNotNull())
    titles = F.transform(F.filter(F.col(blocks), is_heading), lambda b: F.struct(b["level"].alias("level"), b["content"].alias("title")))
    rows = documents.withColumns({"_at": at, "_paths": positional_paths(titles)})

    def section(k: Column) -> Column:
        begin = F.when(k == 0, 0).otherwise(F.get("_at", k - 1))
        end = F.coalesce(F.get("_at", k), F.size(blocks) + 1)
        path = F.when(k == 0, F.array().cast("array<string>")).otherwise(F.transform(F.get("_paths", k - 1), lambda p: p["title"]))
        return F.struct(path.alias("path"), F.slice(blocks, begin + 1, end - begin - 1).alias("blocks"))

    exploded = rows.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("_at")), section)).alias("section", "_s"))
    return exploded.drop("_at", "_paths", blocks).select("*", "_s.path", "_s.blocks").drop("_s").filter(F.size("blocks") > 0)


def _units_of(blocks: Column, budget: Budget, splits: tuple[str, ...] | None, sticky: tuple[str, ...], alone: bool = True) -> Column:
    """Blocks as units: those over the target are cut into sentences (only types in ``splits``; None: all). ``alone``: a unit of them that exceeds
    the budget makes a chunk by itself. Tokens are counted again only where a block is cut."""
    may_split = lambda b: F.lit(True) if splits is None else b["type"].isin(*splits)
    unit = lambda b, c, t: F.struct(c.alias("content"), t.alias("t"), (~b["type"].isin(*sticky)).alias("keep"), (may_split(b) & alone).alias("alone"), b["type"].alias("type"), b["page"].alias("page"))
    cut = lambda b: F.transform(sentences(b["content"]), lambda c: unit(b, c, token_count(c)))
    return F.flatten(F.transform(blocks, lambda b: F.when(may_split(b) & (b["tokens"] > budget.target), cut(b)).otherwise(F.array(unit(b, b["content"], b["tokens"])))))


def _members(packed: DataFrame) -> DataFrame:
    """A row for each of ``_chunks``: its number ``_n`` and its units ``_m``. It holds no others of the section's ``units``."""
    members = F.transform("_chunks", lambda numbers: F.transform(numbers, lambda i: F.get("units", i)))
    return packed.select(*(c for c in packed.columns if c not in ("units", "_chunks")), F.posexplode(members).alias("_n", "_m"))


def _tokens(units: Column) -> Column:
    """Tokens of the units together: no token reaches over the white space between them."""
    return F.aggregate(units, F.lit(0), lambda n, u: n + u["t"])


def _emit(sections: DataFrame, budget: Budget, owner: str) -> DataFrame:
    """Chunks of sections with ``units``: numbered through each document, chunks without a body left out. Only what the chunks show is exchanged."""
    light = F.transform("units", lambda u, i: F.struct(i.alias("i"), u["t"].alias("t"), u["keep"].alias("keep"), u["alone"].alias("alone")))
    titled = sections.withColumn("_prefix", F.array_join("path", "\n")).withColumn("_prefix_tokens", token_count(F.col("_prefix")))
    rows = _members(titled.withColumn("_chunks", pack(light, F.col("_prefix_tokens"), budget)))
    body = strip(F.array_join(F.filter(F.transform("_m", lambda u: strip(u["content"])), lambda x: x != ""), "\n"))
    text = F.when(F.col("_prefix") != "", strip(F.concat("_prefix", F.lit("\n\n"), "_body"))).otherwise(F.col("_body"))
    pages = F.array_sort(F.array_distinct(F.filter(F.transform("_m", lambda u: u["page"]), lambda p: p.isNotNull() & (p != 0))))
    types = F.array_sort(F.array_distinct(F.transform("_m", lambda u: u["type"])))
    # No filter moves below a generator, so the body is made once.
    rows = rows.withColumn("_body", F.explode(F.filter(F.array(body), lambda x: x != "")))
    rows = rows.withColumns({"text": text, "token_count": F.col("_prefix_tokens") + _tokens(F.col("_m")), "page_numbers": pages, "block_types": types}).drop("_m", "_prefix", "_body")
    index = (F.row_number().over(Window.partitionBy("file_id").orderBy("section", "_n")) - 1).alias("chunk_index")
    made = rows.select("*", index).withColumn("content_hash", content_hash(F.col("text")))
    made = made.withColumn("chunk_id", chunk_id(F.col(owner), F.col("chunk_index"), F.col("content_hash")))
    extras = [c for c in sections.columns if c not in ("file_id", "section", "path", "blocks", "units")]
    return made.select(
        "file_id", *extras, "chunk_id", "chunk_index", "text", "token_count", "content_hash",
        F.coalesce(F.get("path", F.lit(0)), F.lit("")).alias("chapter"), F.when(F.size("path") > 1, F.element_at("path", -1)).otherwise("").alias("section"),
        F.array_join("path", " > ").alias("heading"), "page_numbers", F.get("page_numbers", F.lit(0)).alias("page_number"), "block_types",
    )


def pdf_chunks(blocks: DataFrame, budget: Budget = Budget(), alone: bool = True) -> DataFrame:
    """Chunks of cleaned PDF blocks (file_id, block_idx, block_type, content, page_number, heading_level). A sentence that exceeds the budget
    makes a chunk by itself, or (not ``alone``) stands with its neighbours as any other."""
    heading = F.col("block_type").isin("title", "heading")
    parts = blocks.repartition("file_id").select("file_id", "block_idx", "block_type", "page_number", "heading_level", F.posexplode(F.when(heading, split_numbered(F.col("content"))).otherwise(F.array("content"))).alias("part", "content"))
    level = F.when(heading, positional_level(F.col("content"), F.coalesce(marker_level(F.col("content")), F.col("heading_level"))))
    block = F.struct("block_idx", "part", F.col("block_type").alias("type"), "content", level.cast("int").alias("level"), F.col("page_number").alias("page"), token_count(F.col("content")).alias("tokens"))
    documents = parts.groupBy("file_id").agg(F.sort_array(F.collect_list(block)).alias("_blocks"))
    units = _units_of(F.col("blocks"), budget, ("paragraph",), ("table", "image", "formula", "code"), alone)
    return _emit(_sections(documents, "_blocks", ("title", "heading")).withColumn("units", units), budget, "file_id")


def word_chunks(elements: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Chunks of cleaned Word elements (file_id, file_name, element_idx, element_type, level, content). Ids are of the file's name."""
    block = F.struct("element_idx", F.col("element_type").alias("type"), "content", F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)).cast("int").alias("level"), F.lit(None).cast("int").alias("page"), token_count(F.col("content")).alias("tokens"))
    documents = elements.repartition("file_id").groupBy("file_id").agg(F.min("file_name").alias("file_name"), F.sort_array(F.collect_list(block)).alias("_blocks"))
    units = _units_of(F.col("blocks"), budget, None, ())
    return _emit(_sections(documents, "_blocks", ("heading",)).withColumn("units", units), budget, "file_name")


# Element types that are never cut.
ATOMIC = ("code", "table", "list", "blockquote", "html", "image")


def _markdown_parts(content: Column, most: int) -> Column:
    """Pieces of at most ``most`` tokens: sentences gathered by newlines; a longer sentence is cut every 2 * ``most`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("tokens"))
    gathered = lambda a: F.when(F.size(a["held"]) > 0, F.concat(a["done"], F.array(F.array_join(a["held"], "\n")))).otherwise(a["done"])

    def state(done: Column, held: Column, tokens: Column) -> Column:
        return F.struct(done.alias("done"), held.alias("held"), tokens.alias("tokens"))

    def step(acc: Column, s: Column) -> Column:
        t = token_count(s)
        closed = F.when((F.size(acc["held"]) > 0) & (acc["tokens"] + t > most), state(gathered(acc), F.array().cast("array<string>"), F.lit(0))).otherwise(acc)
        slices = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(2 * most)), lambda o: strip(F.substring(s, o + 1, F.lit(2 * most)))), lambda x: x != "")
        return let(closed, lambda c: F.when(t > most, state(F.concat(c["done"], slices), c["held"], c["tokens"])).otherwise(state(c["done"], F.concat(c["held"], F.array(s)), c["tokens"] + t)))

    return F.aggregate(sentences_spaced(content), start, step, gathered)


def markdown_chunks(elements: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Chunks of cleaned Markdown elements (file_id, element_idx, element_type, content, heading_path and heading_levels arrays,
    line_start, line_end). A chunk never crosses heading paths; headings are units, so a heading alone makes a chunk."""
    piece = lambda content, t: F.struct(content.alias("content"), t.alias("t"))
    cut = let(_markdown_parts(F.col("content"), budget.most), lambda parts: F.transform(F.when(F.size(parts) > 0, parts).otherwise(F.array("content")), lambda c: piece(c, token_count(c))))
    parts = let(token_count(F.col("content")), lambda t: F.when(F.col("element_type").isin(*ATOMIC) | (t <= budget.most), F.array(piece(F.col("content"), t))).otherwise(cut))
    pieces = elements.repartition("file_id").select("file_id", "element_idx", "element_type", "heading_path", "heading_levels", "line_start", "line_end", F.posexplode(parts).alias("part", "_p")).select("*", "_p.content", "_p.t").drop("_p")
    w = Window.partitionBy("file_id").orderBy("element_idx", "part")
    moved = F.when(F.col("heading_path").eqNullSafe(F.lag("heading_path").over(w)), 0).otherwise(1)
    runs = pieces.withColumn("_moved", moved).withColumn("section", F.sum("_moved").over(w))
    unit = F.struct("element_idx", "part", "content", "t", F.col("element_type").alias("type"), "line_start", "line_end")
    grouped = runs.groupBy("file_id", "section").agg(F.min_by("heading_path", "element_idx").alias("path"), F.min_by("heading_levels", "element_idx").alias("levels"), F.sort_array(F.collect_list(unit)).alias("units"))
    light = F.transform("units", lambda u, i: F.struct(i.alias("i"), u["t"].alias("t"), (u["type"] == "paragraph").alias("keep"), F.lit(False).alias("alone")))
    rows = _members(grouped.withColumn("_chunks", pack(light, F.lit(0), budget, flush_at_target=True)))
    level = lambda i: F.greatest(F.coalesce(F.get("levels", i), i + 1), F.lit(1))
    prefix = F.array_join(F.transform("path", lambda title, i: F.concat(F.repeat(F.lit("#"), level(i)), F.lit(" "), title)), "\n")
    shown = F.filter("_m", lambda u: (u["type"] != "heading") & (strip(u["content"]) != ""))
    rows = rows.withColumns({"_prefix": prefix, "_shown": shown}).withColumn("_body", strip(F.array_join(F.transform("_shown", lambda u: u["content"]), "\n\n")))
    text = F.when((F.col("_body") != "") & (F.col("_prefix") != ""), strip(F.concat("_prefix", F.lit("\n\n"), "_body"))).when(F.col("_body") != "", F.col("_body")).otherwise(F.col("_prefix"))
    index = (F.row_number().over(Window.partitionBy("file_id").orderBy("section", "_n")) - 1).alias("chunk_index")
    found = {
        "text": text, "token_count": token_count(F.col("_prefix")) + _tokens(F.col("_shown")), "block_types": F.array_sort(F.array_distinct(F.transform("_m", lambda u: u["type"]))),
        "line_start": F.array_min(F.transform("_m", lambda u: u["line_start"])), "line_end": F.array_max(F.transform("_m", lambda u: u["line_end"])),
    }
    made = rows.withColumns(found).drop("_m", "_shown", "_prefix", "_body").select("*", index).withColumn("content_hash", content_hash(F.col("text")))
    made = made.withColumn("chunk_id", chunk_id(F.col("file_id"), F.col("chunk_index"), F.col("content_hash")))
    return made.select(
        "file_id", "chunk_id", "chunk_index", "text", "token_count", "content_hash",
        F.get("path", F.lit(0)).alias("chapter"), F.when(F.size("path") > 1, F.element_at("path", -1)).otherwise("").alias("section"),
        F.array_join("path", " > ").alias("heading"), F.array_join("path", " > ").alias("heading_path"), F.col("levels").alias("heading_levels"),
        "block_types", "line_start", "line_end",
    )

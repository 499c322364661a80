"""Best-fit packing of documents into sequences of several permitted lengths.

A document longer than the longest sequence fills whole ones of that length; what is left of it, and every other
document, is an item. Items are dealt by the hash of their key into shards of about ``shard_items``, and each shard is
packed by itself, longest item first: an item goes to the open bin with the least room that holds it (best fit). Where
none does, a bin is opened, and its size is chosen among all permitted lengths at once: for each, the shard's remaining
items tell how far it could be filled, and the least cost (length plus ``overhead``) per token filled wins. In the end
each bin is downsized to the shortest permitted length that holds its contents. A shard's last bins are its only loss
against packing everything at once.

``pack`` says where each piece of a document goes; ``sequences`` builds the packed token sequences themselves.

Defined results: an item without tokens (null or empty text) has one row with length 0 and no bin, and is in no sequence. Rows
that repeat a key are items of their own, in bins of their own or beside each other; their key may be null. Items of one length go in the order
of their keys' hashes, equal keys in the order of their rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.skew import anti_join, lookup_join, semi_join
from tesserae.session import discard, stored

SHARD_ITEMS = 8192


def word_count(text: Column) -> Column:
    """Tokens by the default measure: words apart by ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def best_fit(lengths: Sequence[int], capacities: Sequence[int], overhead: float = 0.0) -> tuple[list[int], list[int], list[int]]:
    """Packs lengths between 1 and the largest capacity: each item's bin, its offset in the bin, and the bins' final capacities."""
    sizes = sorted(set(capacities))
    if lengths and (min(lengths) < 1 or max(lengths) > sizes[-1]):
        raise ValueError("lengths must be between 1 and the largest capacity")
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    left = [0] * (sizes[-1] + 1)
    for n in lengths:
        left[n] += 1
    left_mask = sum(1 << n for n, k in enumerate(left) if k)
    room: dict[int, list[int]] = {}
    room_mask = 0
    bin_of, offset, used, capacity = [0] * len(lengths), [0] * len(lengths), [], []

    def fill(space: int, mask: int) -> int:
        """Tokens that the remaining items could add to an empty space, always taking the longest that fits."""
        got, taken = 0, {}
        while space:
            mask &= (1 << (space + 1)) - 1
            if not mask:
                break
            n = mask.bit_length() - 1
            k = min(space // n, left[n] - taken.get(n, 0))
            if k > 0:
                got, space = got + k * n, space - k * n
                taken[n] = taken.get(n, 0) + k
            mask &= ~(1 << n)
        return got

    for i in order:
        n = lengths[i]
        left[n] -= 1
        if not left[n]:
            left_mask &= ~(1 << n)
        fitting = room_mask >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            b = room[space].pop()
            if not room[space]:
                room_mask &= ~(1 << space)
        else:
            c = min((s for s in sizes if s >= n), key=lambda s: ((s + overhead) / (n + fill(s - n, left_mask)), -s))
            b, space = len(used), c
            used.append(0)
            capacity.append(c)
        bin_of[i], offset[i] = b, used[b]
        used[b] += n
        space -= n
        if space:
            room.setdefault(space, []).append(b)
            room_mask |= 1 << space
    return bin_of, offset, [next(s for s in sizes if s >= u) for u in used]


def mark(text: Column) -> Column:
    """Tells rows apart that share a key."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def pack(items: DataFrame, capacities: Sequence[int] = (512, 1024, 2048, 4096), key: str = "doc_id", length: Column | None = None, overhead: float = 8.0, shard_items: int = SHARD_ITEMS, text: str = "text") -> DataFrame:
    """One row per piece of a document: ``key``, ``piece`` (from 0), ``start`` and ``length`` (the piece's tokens in the
    document), ``bin_id``, ``bin_length`` (the permitted length of its bin), ``position`` (its first token in the bin), and
    what tells rows apart that share a key: ``mark``, a hash of the column ``text`` (null without one), and the number ``row``."""
    sizes = sorted({int(c) for c in capacities})
    if not sizes or sizes[0] < 1:
        raise ValueError("capacities must be positive")
    top = sizes[-1]
    measure = word_count(F.col(text)) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    own = mark(F.col(text)) if text in items.columns else F.lit(None).cast("long")
    numbered = stored(items.select(F.col(key).alias("k"), measure.alias("n"), own.alias("mark"), F.monotonically_increasing_id().alias("row")), "lengths")
    kind = numbered.schema["k"].dataType.simpleString()
    # Only rows that share a key are told apart by their number, so names and shards of the others don't depend on how rows come in.
    repeated = stored(numbered.filter("k is not null").groupBy("k").agg(F.count("*").alias("m")).filter("m > 1"), "repeated")
    lengths = lookup_join(numbered, repeated.withColumn("again", F.lit(True)), "k", "m", spread=F.col("row")).withColumn("again", F.coalesce("again", F.col("k").isNull()))
    name = F.when(F.col("again"), F.concat(F.lit("r"), F.col("row").cast("string"))).otherwise(F.concat(F.lit("w"), F.col("k").cast("string")))
    lengths = stored(lengths.select("k", "n", "mark", "row", name.alias("name"), F.when(F.col("again"), F.xxhash64(F.lit("pack"), "k", "row")).otherwise(F.xxhash64(F.lit("pack"), "k")).alias("h")), "lengths")
    discard(items.sparkSession, numbered, repeated)
    shards = max(1, -(-lengths.count() // shard_items))
    whole = F.floor(F.col("n") / top).cast("int")
    full = (
        lengths.filter(F.col("n") >= top)
        .select("k", "mark", "row", "name", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
        .select("k", "piece", (F.col("piece").cast("long") * top).alias("start"), F.lit(top).cast("long").alias("length"), F.concat("name", F.lit("."), F.col("piece")).alias("bin_id"), F.lit(top).alias("bin_length"), F.lit(0).alias("position"), "mark", "row")
    )
    empty = lengths.filter("n = 0").select("k", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.col("n").alias("length"), F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("int").alias("bin_length"), F.lit(None).cast("int").alias("position"), "mark", "row")
    rest = lengths.filter(F.col("n") % top > 0).select(F.col("k").cast("string").alias("k"), whole.alias("piece"), (F.col("n") % top).cast("int").alias("n"), "mark", "row", "h", F.pmod(F.col("h"), F.lit(shards)).alias("shard"))

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n", "h", "row", "piece"], kind="stable", ignore_index=True)
        bins, offsets, final = best_fit(shard["n"].tolist(), sizes, overhead)
        return pd.DataFrame({
            "k": shard["k"], "piece": shard["piece"], "start": shard["piece"].astype("int64") * top, "length": shard["n"].astype("int64"),
            "bin_id": [f"s{s}.{b}" for s, b in zip(shard["shard"], bins)], "bin_length": [final[b] for b in bins], "position": offsets, "mark": shard["mark"], "row": shard["row"],
        })

    packed = rest.groupBy("shard").applyInPandas(run, "k string, piece int, start long, length long, bin_id string, bin_length int, position int, mark long, row long")
    packed = packed.withColumn("k", F.col("k").cast(kind))  # numbers with nulls among them would be rounded on the way
    return packed.unionByName(full).unionByName(empty).withColumnRenamed("k", key)


def sequences(documents: DataFrame, packed: DataFrame, key: str = "doc_id", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """The packed sequences: ``bin_id``, ``bin_length``, ``keys``, ``lengths`` (each part's tokens) and ``tokens``, in the order of the bin. A bin
    holds no more than its permitted length, so no array outgrows it. ``tokens`` are the words of the text unless an array
    column is given, which must have as many items as ``pack`` was told.

    A document's tokens are cut into its pieces in one row and exchanged by bin once, words as one text. Rows that repeat key and
    text share their tokens; each has its own pieces."""
    piece = F.struct("start", "length", "bin_id", "bin_length", "position")
    who = lambda k, m: F.struct(k.alias("k"), m.alias("m")).alias("d")  # noqa: E731  one column: the rows are exchanged by it once, for both steps
    wanted = packed.filter("bin_id is not null").select(who(F.col(key), F.col("mark")), "row", piece.alias("p")).groupBy("d", "row").agg(F.collect_list("p").alias("pieces"))
    rows = documents.select(who(F.col(key), mark(F.col(text))), F.col(text).alias("x"), *([] if tokens is None else [tokens.alias("t")]))
    plain = lambda d: [F.coalesce(d["k"].cast("string"), F.lit("")).alias("k"), d["k"].isNull().alias("none"), d["m"].alias("m")]
    again = stored(wanted.groupBy("d").agg(F.min("row").alias("a"), F.max("row").alias("b")).filter("a <> b").select(*plain(F.col("d"))), "again")
    # Only what is repeated is looked through for repeats: the texts of all others are exchanged for the join alone.
    rows = anti_join(rows, plain(F.col("d")), again).unionByName(semi_join(rows, plain(F.col("d")), again).dropDuplicates(["d"]))
    split = F.filter(F.split(F.col("x").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "") if tokens is None else F.col("t")
    joined = lambda part: F.array_join(part, " ") if tokens is None else part
    cut = lambda w: F.transform("pieces", lambda p: F.struct(p["bin_id"].alias("bin_id"), p["bin_length"].alias("bin_length"), p["position"].alias("position"), p["length"].cast("int").alias("length"), joined(F.slice(w, (p["start"] + 1).cast("int"), p["length"].cast("int"))).alias("tokens")))
    met = rows.join(wanted, "d")
    # The outer transform stands for "let": the array of words is made once.
    parts = met.select(F.col("d.k").alias("key"), F.explode(F.flatten(F.transform(F.array(split), cut))).alias("p")).select("key", "p.*")
    grouped = parts.groupBy("bin_id", "bin_length").agg(F.sort_array(F.collect_list(F.struct("position", "key", "length", "tokens"))).alias("p"))
    whole = F.split(F.array_join(F.col("p.tokens"), " "), " ") if tokens is None else F.flatten(F.col("p.tokens"))
    return grouped.select("bin_id", "bin_length", F.col("p.key").alias("keys"), F.col("p.length").alias("lengths"), whole.alias("tokens"))

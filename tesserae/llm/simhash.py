"""SimHash document fingerprints, and the search for fingerprints within a Hamming radius. DataFrame functions only.

A text's terms are its runs of five words (its whole sequence, if shorter); each occurrence votes once on each of the
128 bits of the term's hash, so a term weighs as often as it occurs. Two votes share a 64-bit sum (32 bits each), and
the sums are taken next to where the terms are made, without an exchange: the rows keep the partitioning of the step before.

Near copies are texts whose sets of terms have a Jaccard similarity of 0.8 or more. Their fingerprints differ in about 19
bits at 0.8 and at most 26 in the test data, hence ``RADIUS``. ``near_counts`` is complete: the 128 bits are cut into ``BANDS`` bands, a table
per band, and of a pair within the radius some band differs in no more than its share of it (26 bits over nine bands: two bits in one of
them, or else there were 27). A query is looked up under its own band and under those that differ in so many bits; a pair is
counted in the first table where it meets, after its whole distance is checked, so no pair counts twice, none is beyond the radius and
none is missed. A query meets 6 % of the fingerprints by chance; what leaves the join is a sum per query.

For small radii ``within_radius`` is complete: it cuts fingerprints into ``blocks``; within ``radius`` differing bits at least
``blocks - radius`` blocks agree, so two fingerprints in reach meet in one of the tables keyed by that many chosen blocks.
Equal fingerprints are one row in either search, however many documents share them.

Defined results: a null text is an empty one; texts without words have the fingerprint of all zeros; equal texts have
equal fingerprints; rows that repeat a key follow each other by text; a null key sorts before all others.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.skew import lookup_join
from tesserae.session import stored

BITS = 128
WORDS = 5
RADIUS = 26
BANDS = 9
CLOSE = 4
BLOCKS = 6
CELLS = 4096
_LANES = 0x0000000100000001


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def terms(text: Column, size: int = WORDS) -> Column:
    """Hashes of the runs of ``size`` words."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        n = F.size(h)
        return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    # The inner transform stands for "let": the array of word hashes is made once.
    return F.flatten(F.transform(F.array(hashes), runs))


def votes(term: str) -> list[Column]:
    """Sums of the set bits: bit i of either half of the hash, and bit 32 + i of it in the upper lane."""
    halves = (F.col(term), F.xxhash64(F.lit(1), F.col(term)))
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_LANES))).alias(f"v{k}_{i}") for k, h in enumerate(halves) for i in range(32)]


def signs(half: int, count: Column) -> Column:
    """The fingerprint's half: a bit is set where more than half of the votes were."""

    def bit(ones: Column, place: int) -> Column:
        return F.when(ones * 2 > count, F.lit((1 << place) - (1 << 64) * (place == 63))).otherwise(F.lit(0).cast("long"))

    parts = []
    for i in range(32):
        s = F.col(f"v{half}_{i}")
        parts += [bit(s.bitwiseAND(F.lit(0xFFFFFFFF)), i), bit(F.shiftrightunsigned(s, 32), 32 + i)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def fingerprints(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """``by``, ``hi`` and ``lo`` of each row; ``by`` names the rows. If ``rows`` are partitioned by a part of ``by`` already, nothing is exchanged."""
    exploded = rows.select(*by, F.explode_outer(terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    summed = exploded.groupBy(*by).agg(*votes("term"), F.count("term").alias("n"))
    sign = lambda half: F.when(F.col("n") > 0, signs(half, F.col("n"))).otherwise(F.lit(0).cast("long"))
    return summed.select(*by, sign(0).alias("hi"), sign(1).alias("lo"))


def hexadecimal(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return 1 - distance(a, b) / float(BITS)


def _home(place: Column, firsts: list[int]) -> Column:
    """The last of the ascending ``firsts`` that is no more than ``place``: looked up among every 64th, then among those after it."""
    if len(firsts) < 2:
        return F.lit(0)
    count = lambda values: F.size(F.filter(values, lambda x: x <= place))
    known, coarse = F.array(*map(F.lit, firsts)), F.array(*map(F.lit, firsts[::64]))
    block = (F.greatest(count(coarse), F.lit(1)) - 1) * 64
    return (block + F.greatest(count(F.slice(known, block + 1, F.lit(64))), F.lit(1)) - 1).cast("int")


def in_order(documents: DataFrame, key: str) -> tuple[DataFrame, list[int]]:
    """The rows in buckets that are ranges of the key (``_bucket``), each with the first row of the next bucket as a guest at
    its end (``_guest``), after the last bucket the first row of all. Looking one row ahead then never leaves a bucket.

    The buckets start at quantiles of the key, so they are alike in rows however the keys lie; at most ``CELLS`` of them are known
    to the driver. Rows that share a key are in one bucket."""
    spark = documents.sparkSession
    low = documents.agg(F.min(key).cast("long")).first()[0]
    low = 0 if low is None else low - 1  # null keys sort before all others
    place = F.coalesce(F.col(key).cast("long"), F.lit(low).cast("long"))
    buckets = min(CELLS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = documents.agg(F.min(place).alias("first"), F.percentile_approx(place, [i / buckets for i in range(1, buckets)], 100 * buckets).alias("starts")).first()
    firsts = sorted({found["first"], *found["starts"]}) if found["first"] is not None else []
    last = len(firsts) - 1
    spot = lambda bucket, guest: F.struct(bucket.alias("_bucket"), F.lit(guest).alias("_guest"))
    own = spot(F.col("_home"), 0)
    guest = F.when(F.col("_place").isin(firsts[:1]), F.array(own, spot(F.lit(last), 1)))
    if last > 0:
        guest = guest.when(F.col("_place").isin(firsts[1:]), F.array(own, spot(F.col("_home") - 1, 1)))
    placed = documents.withColumn("_place", place).withColumn("_home", _home(F.col("_place"), firsts))
    return placed.withColumn("_spot", F.explode(guest.otherwise(F.array(own)))).select("*", "_spot._bucket", "_spot._guest").drop("_spot", "_home"), firsts


def compare_edited(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``n_chars``, ``edited_sha256``, the fingerprints (``hi``, ``lo``, ``edited_hi``, ``edited_lo``) and the likeness to
    the edited text's (``near_edited``) and the next document's (``near_next``). The edited text has its last half replaced
    by the beginning of the next document by key (after the last: the first)."""
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    spread, _ = in_order(rows, "key")
    order = Window.partitionBy("_bucket").orderBy("_guest", "_place", "text")
    n = F.length("text").cast("long")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    ahead = spread.select("key", "_bucket", "_guest", "text", n.alias("n_chars"), F.row_number().over(order).alias("_row"), F.lead("text").over(order).alias("_next"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    both = ahead.withColumn("_edited", F.when(F.col("_guest") == 0, edited))
    by = ["_bucket", "_row", "_guest", "key", "n_chars", "edited_sha256", "_kind"]
    named = both.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    kinds = F.when(F.col("_guest") == 1, F.array(F.struct(F.lit(0).alias("_kind"), F.col("text").alias("_text")))).otherwise(F.array(F.struct(F.lit(0).alias("_kind"), F.col("text").alias("_text")), F.struct(F.lit(1).alias("_kind"), F.col("_edited").alias("_text"))))
    each = named.select(*by[:-1], F.explode(kinds).alias("_k")).select(*by[:-1], "_k._kind", "_k._text")
    marks = fingerprints(each, by, "_text")
    pick = lambda c, k: F.max(F.when(F.col("_kind") == k, F.col(c)))
    joined = marks.groupBy(*by[:-1]).agg(pick("hi", 0).alias("hi"), pick("lo", 0).alias("lo"), pick("hi", 1).alias("edited_hi"), pick("lo", 1).alias("edited_lo"))
    follow = Window.partitionBy("_bucket").orderBy("_row")
    whole = joined.withColumns({"_nhi": F.lead("hi").over(follow), "_nlo": F.lead("lo").over(follow)}).filter("_guest = 0")
    own = (F.col("hi"), F.col("lo"))
    return whole.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", "hi", "lo", "edited_hi", "edited_lo",
        likeness(own, (F.col("edited_hi"), F.col("edited_lo"))).alias("near_edited"), likeness(own, (F.col("_nhi"), F.col("_nlo"))).alias("near_next"),
    )


def _halves(bits: int) -> tuple[int, int]:
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(bits >> 64), signed(bits & ((1 << 64) - 1))


def block_keys(hi: Column, lo: Column, radius: int = CLOSE, blocks: int = BLOCKS) -> Column:
    """The keys of all tables: for each choice of ``blocks - radius`` blocks, a hash of the table's number and the chosen bits."""
    if not 0 <= radius < blocks <= 32:
        raise ValueError("there must be more blocks than bits in the radius")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]

    def masks(chosen: tuple[int, ...]) -> tuple[int, int]:
        return _halves(sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in chosen))

    tables = [masks(c) for c in combinations(range(blocks), blocks - radius)]
    return F.array(*(F.xxhash64(F.lit(t), hi.bitwiseAND(F.lit(h)), lo.bitwiseAND(F.lit(low))) for t, (h, low) in enumerate(tables)))


def within_radius(queries: DataFrame, corpus: DataFrame, radius: int = CLOSE, blocks: int = BLOCKS) -> DataFrame:
    """All pairs of different fingerprints (``hi``, ``lo``, ``other_hi``, ``other_lo``, ``distance``) of the queries and the corpus
    within the radius. Both must have each fingerprint once (columns ``hi`` and ``lo``)."""
    asked = queries.select("hi", "lo", F.explode(block_keys(F.col("hi"), F.col("lo"), radius, blocks)).alias("block_key"))
    there = corpus.select(F.col("hi").alias("other_hi"), F.col("lo").alias("other_lo"), F.explode(block_keys(F.col("hi"), F.col("lo"), radius, blocks)).alias("block_key"))
    apart = distance((F.col("hi"), F.col("lo")), (F.col("other_hi"), F.col("other_lo")))
    return asked.join(there, "block_key").withColumn("distance", apart).filter(F.col("distance").between(1, radius)).select("hi", "lo", "other_hi", "other_lo", "distance").distinct()


def band_shares(radius: int = RADIUS, bands: int = BANDS) -> list[tuple[list[int], int]]:
    """The bits of each band, and in how many of them a pair may differ to meet there. Shares of s bits exclude pairs of fewer than s + 1 bits in a
    band, so the shares plus one make up ``radius + 1`` between them."""
    bands = min(bands, radius + 1)
    return [(list(range(BITS * b // bands, BITS * (b + 1) // bands)), (radius + 1) // bands + (b < (radius + 1) % bands) - 1) for b in range(bands)]


def _band_key(hi: Column, lo: Column) -> Column:
    return F.xxhash64("t", hi.bitwiseAND(F.col("h")), lo.bitwiseAND(F.col("l")))


def near_classes(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """For each query fingerprint (``hi``, ``lo``) with others of the corpus (``hi``, ``lo``, ``n``) within the radius: the sum ``around`` of
    their ``n``. Both must have each fingerprint once. All pairs are found."""
    spark, shares = queries.sparkSession, band_shares(radius, bands)
    masks = [_halves(sum(1 << b for b in bits)) for bits, _ in shares]
    flips = [(t, *masks[t], *_halves(sum(1 << b for b in c))) for t, (bits, most) in enumerate(shares) for k in range(most + 1) for c in combinations(bits, k)]
    probes = F.broadcast(spark.createDataFrame(flips, "t int, h long, l long, fh long, fl long"))
    tables = F.broadcast(spark.createDataFrame([(t, *m) for t, m in enumerate(masks)], "t int, h long, l long"))
    asked = queries.select("hi", "lo").crossJoin(probes).select("hi", "lo", "t", _band_key(F.col("hi").bitwiseXOR(F.col("fh")), F.col("lo").bitwiseXOR(F.col("fl"))).alias("band_key"))
    there = corpus.select(F.col("hi").alias("other_hi"), F.col("lo").alias("other_lo"), F.col("n").alias("other_n")).crossJoin(tables).select("other_hi", "other_lo", "other_n", _band_key(F.col("other_hi"), F.col("other_lo")).alias("band_key"))
    apart = distance((F.col("hi"), F.col("lo")), (F.col("other_hi"), F.col("other_lo")))
    first = F
    for t, ((h, low), (_, most)) in enumerate(zip(masks, shares)):
        differ = F.bit_count(F.col("hi").bitwiseXOR(F.col("other_hi")).bitwiseAND(F.lit(h))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("other_lo")).bitwiseAND(F.lit(low)))
        first = first.when(differ <= most, t)
    met = asked.join(there, "band_key").filter(apart.between(1, radius)).filter(first == F.col("t"))
    return met.groupBy("hi", "lo").agg(F.sum("other_n").alias("around"))


def near_counts(marked: DataFrame, asked: Column, radius: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """``marked`` (with ``hi`` and ``lo``) and ``n_near``: for rows where ``asked`` holds, how many other rows have a
    fingerprint within the radius, equal ones included; null for the rest."""
    marked = stored(marked, "fingerprints")
    classes = stored(marked.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max(asked.cast("int")).alias("asked")), "classes")
    around = near_classes(classes.filter("asked = 1"), classes, radius, bands)
    totals = classes.filter("asked = 1").join(around, ["hi", "lo"], "left").select(F.struct("hi", "lo").alias("mark"), "n", (F.col("n") - 1 + F.coalesce("around", F.lit(0))).alias("n_near"))
    joined = lookup_join(marked.withColumn("mark", F.when(asked, F.struct("hi", "lo"))), totals, "mark", "n", spread=F.xxhash64(*marked.columns))
    return joined.drop("mark")

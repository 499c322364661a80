"""Joins whose keys may be held by a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.session import bundled

TOP = 1000


def lookup_join(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column, top: int = TOP, rows: int | None = None) -> DataFrame:
    """Left join of ``left`` with the columns of ``right``, which has one row per ``key`` and, in ``weight``, about how
    many rows of ``left`` hold that key. The columns of ``left`` may have any names; a column of ``right`` replaces none of them.

    The ``top`` heaviest keys are broadcast (never more than ``top`` rows); no other key can then hold more than
    1/``top`` of the rows. Rows answered by the broadcast go through the second join with a salt from ``spread`` (an
    expression that differs between rows), so they spread evenly and match nothing there. Where ``rows``, the number of
    rows of ``right``, is known and no more than ``top``, the broadcast answers everything and ``left`` isn't shuffled.
    """
    values = [c for c in right.columns if c not in (key, weight)]
    heavy = right.orderBy(F.desc(weight), key).limit(top).select(F.col(key).alias("hk"), F.struct(*values).alias("hv"))
    packed = left.select(bundled(left, left.columns).alias("l"), F.col(key).alias("k"), F.xxhash64(spread).bitwiseOR(F.lit(1).cast("long")).alias("x"))
    met = packed.join(F.broadcast(heavy), F.col("k") == F.col("hk"), "left")
    own = [F.col("l")[c].alias(c) for c in left.columns]
    if rows is not None and rows <= top:
        return met.select(*own, *(F.col("hv")[c].alias(c) for c in values))
    # The salt of the right side is 0, but not as a constant: the optimizer would take it out of the join's keys.
    rest = right.select(F.col(key).alias("rk"), F.pmod(F.xxhash64(F.col(key)), F.lit(1).cast("long")).alias("rs"), F.struct(*values).alias("rv"))
    salted = met.withColumn("ls", F.when(F.col("hv").isNull(), F.lit(0).cast("long")).otherwise(F.col("x")))
    joined = salted.join(rest, (F.col("k") == F.col("rk")) & (F.col("ls") == F.col("rs")), "left")
    found = F.coalesce("hv", "rv")
    return joined.select(*own, *(found[c].alias(c) for c in values))


#: Keys that are broadcast as they are: rows of a few numbers, 5 MB at most.
FEW = 100_000
#: A blocked Bloom filter has so many bitmaps of 4 kB (8 MB in all, whatever the tables' sizes).
_MAPS = 2048
_BITS = 32_768


def _filtered(left: DataFrame, keys: list[Column], ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``left`` as a struct ``l`` beside its keys, and the same with ``hit``, whether a Bloom filter of ``ids`` may hold the row's keys."""

    def places(own: list[Column]) -> tuple[Column, list[Column]]:
        return F.pmod(F.xxhash64(F.lit(0), *own), F.lit(_MAPS)), [F.pmod(F.xxhash64(F.lit(i), *own), F.lit(_BITS)) for i in (1, 2, 3)]

    bucket, bits = places([F.col(c) for c in ids.columns])
    marked = ids.select(bucket.alias("b"), F.explode(F.array(*bits)).alias("bit")).distinct().repartition("b")
    maps = marked.groupBy("b").agg(F.bitmap_construct_agg("bit").alias("map"))
    packed = left.select(bundled(left, left.columns).alias("l"), *(k.alias(f"k{i}") for i, k in enumerate(keys)))
    bucket, bits = places([F.col(f"k{i}") for i in range(len(keys))])
    joined = packed.withColumn("at", bucket).join(F.broadcast(maps), F.col("at") == F.col("b"), "left")
    hit = F.col("map").isNotNull()
    for bit in bits:
        byte = F.conv(F.hex(F.substring("map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = hit & (F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1)
    return packed, joined.withColumn("hit", F.coalesce(hit, F.lit(False)))


def _same(n: int) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"k{i}") == F.col(f"r{i}") for i in range(n)))


def _matched(packed: DataFrame, ids: DataFrame, how: str, small: bool) -> DataFrame:
    named = ids.select(*(F.col(c).alias(f"r{i}") for i, c in enumerate(ids.columns)))
    return packed.join(F.broadcast(named) if small else named, _same(len(ids.columns)), how).select("l.*")


def semi_join(left: DataFrame, keys: list[Column], ids: DataFrame) -> DataFrame:
    """Rows of ``left`` whose ``keys`` are a row of ``ids`` (written already; counted here). Up to ``FEW`` ids are broadcast. Beyond,
    a Bloom filter of fixed size is, and only rows that pass it are exchanged: the long rows of ``left`` mostly stay where they are."""
    if ids.count() <= FEW:
        packed = left.select(bundled(left, left.columns).alias("l"), *(k.alias(f"k{i}") for i, k in enumerate(keys)))
        return _matched(packed, ids, "left_semi", True)
    return _matched(_filtered(left, keys, ids)[1].filter("hit"), ids, "left_semi", False)


def anti_join(left: DataFrame, keys: list[Column], ids: DataFrame) -> DataFrame:
    """Rows of ``left`` whose ``keys`` are no row of ``ids``, in the way of ``semi_join``."""
    if ids.count() <= FEW:
        packed = left.select(bundled(left, left.columns).alias("l"), *(k.alias(f"k{i}") for i, k in enumerate(keys)))
        return _matched(packed, ids, "left_anti", True)
    marked = _filtered(left, keys, ids)[1]
    return _matched(marked.filter("hit"), ids, "left_anti", False).unionByName(marked.filter("not hit").select("l.*"))


def some_join(left: DataFrame, keys: list[Column], right: DataFrame, names: list[str]) -> DataFrame:
    """Left join of ``left`` with the other columns of ``right`` (written already; one row per ``names``). Where most rows of ``left`` have
    no match these aren't exchanged: the ids, or beyond ``FEW`` a Bloom filter of them, tell before. ``right`` brings columns
    that ``left`` hasn't got."""
    ids, values = right.select(*names), [c for c in right.columns if c not in names]
    if ids.count() <= FEW:
        packed = left.select(bundled(left, left.columns).alias("l"), *(k.alias(f"k{i}") for i, k in enumerate(keys)))
        known = ids.select(*(F.col(c).alias(f"r{i}") for i, c in enumerate(names)), F.lit(True).alias("there"))
        marked = packed.join(F.broadcast(known), _same(len(names)), "left").select("l", *(f"k{i}" for i in range(len(names))), F.col("there").isNotNull().alias("hit"))
    else:
        marked = _filtered(left, keys, ids)[1]
    found = right.select(*(F.col(c).alias(f"r{i}") for i, c in enumerate(names)), *values)
    hits = marked.filter("hit").join(found, _same(len(names)), "left").select("l.*", *values)
    misses = marked.filter("not hit").select("l.*", *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in values))
    return hits.unionByName(misses)

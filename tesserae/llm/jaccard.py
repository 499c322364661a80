"""N-gram Jaccard join as a blocked sparse matrix product.

Documents are rows and word n-grams (shingles) columns of an incidence matrix; overlap counts are its product with its own
transpose. Rows with equal sets are one row, the *class*; everything below works on classes.

1. Two sets alike enough share one of the first ``n - ceil(t * n) + 1`` shingles of either in any common order. Only these
   entries are exchanged. The order puts frequent shingles last, and before them those that turn out, in a first run over the
   entries, to be in several rows; so unlike rows share few columns, and columns are short. Entries whose
   column has no other row of a fitting size, or none whose counts of shingles in 64 ranges leave the threshold possible, go.
2. The rows that are left come with their whole sets into blocks: a block gathers the rows that agree on the least of their
   columns by some hash (and, for one of the blocks of each row, on its longest column), so near copies meet whatever
   columns they lost. A block's product accumulates the overlap count of every two of its rows over all columns, short
   columns by their pairs and long ones as dense tiles; counts below the bound that the two sizes give are discarded. The
   links that remain are joined in the worker, which emits one row for each row of the block at most: a spanning forest.
3. What is left are rows of one column that met in no block and aren't connected yet. They are gathered once more, so that each
   two of them meet: all rows that such columns hold together make one block, or each column does, whichever moves less.
   So no link is lost, groups of near copies cost about their size, and nothing is emitted by pairs.

Blocks hold about ``UNIT_ENTRIES`` entries at most: larger ones of step 2 are split by a salt, those of step 3 into
blocks for every two of their parts. ``jaccard_links`` runs the same product but emits all links between classes.

Defined results: sets are empty for null texts and texts without words, and link with nothing; a text of fewer words than
``n`` is its whole sequence. Rows that repeat a key are rows of their own: each links by its own text, and a component's id is
the smallest key of any of its rows. Rows without a key have the component of their set, which only rows with keys make
(null if there is none).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.components import connected_components
from tesserae.llm.wordhash import Words, buffers, mix, slices, tidy
from tesserae.operators.skew import anti_join, lookup_join, semi_join
from tesserae.session import discard, stored, text_batches

COMMON = 65_536
RANGES = 64
PROFILE = [f"p{i}" for i in range(RANGES // 8)]
#: A block's entries and rows, about.
UNIT_ENTRIES = 1_000_000
UNIT_ROWS = 2_048
#: Blocks of each row in step 2.
BLOCKS = 2
#: Columns of more rows in a block are multiplied as dense tiles.
LONG = 24
TILE = 2_048
#: Comparisons beyond which a column's rows are all kept instead.
MOST_TESTS = 50_000_000
SEEN = 1 << 18


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, ascending."""
    data, offsets = buffers(texts)
    for i, j in slices(offsets):
        value, first = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True).shingles(words)
        for k in range(j - i):
            s = np.sort(value[first[k] : first[k + 1]])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s


def _identity(s: np.ndarray, salt: int) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16, key=salt.to_bytes(4, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Order:
    """A common order of shingles: first those not known to be in several rows, by hash; then those that may be (``shared``, a
    filter of one bit for a hash); then the frequent ones by count and hash."""

    def __init__(self, common: list[tuple[int, int]], shared: np.ndarray | None = None):
        pairs = sorted(common)
        self.hashes = np.array([h for h, _ in pairs], dtype=np.int64).view(np.uint64)
        by = np.argsort(self.hashes)
        self.hashes, self.counts = self.hashes[by], np.array([c for _, c in pairs], dtype=np.int64)[by] + 1
        self.shared = shared

    def prefix(self, s: np.ndarray, percent: int) -> np.ndarray:
        n = len(s)
        length = n - (percent * n + 99) // 100 + 1
        count = np.zeros(n, dtype=np.int64)
        if self.shared is not None:
            at = s & np.uint64(8 * len(self.shared) - 1)
            count |= (self.shared[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        if len(self.hashes):
            at = np.searchsorted(self.hashes, s)
            at[at == len(self.hashes)] = 0
            count = np.where(self.hashes[at] == s, self.counts[at], count)
        if count.any():
            s = s[np.argsort(count, kind="stable")]
        return s[:length]


def _profile(s: np.ndarray) -> np.ndarray:
    """How many shingles lie in each of 64 ranges (255 at most), eight counts a number."""
    return np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).view(np.int64)


def _survey(documents: DataFrame, words: int, salt: int) -> DataFrame:
    """Kind 0: key, mark, set size, identity and profile of each row. Kind 1: shingles that a worker saw often, with counts (of unlike sets)."""
    names = ["kind", "key", "mark", "n", "a", "b", *PROFILE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def often() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            keep = count > 2
            n, none = int(keep.sum()), pa.nulls(int(keep.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), none, none, none, pa.array(value[keep].view(np.int64)), pa.array(count[keep], pa.int64()), *[none] * len(PROFILE)], names=names)

        for batch in batches:
            n, who, profiles = [], [], []
            for s in shingle_sets(batch.column(2), words):
                own = _identity(s, salt)
                n.append(len(s))
                who.append(own)
                profiles.append(_profile(s))
                if len(s) and own[0] not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(own[0])
                    # A prefix lies among the lowest hashes, unless many of these are frequent: a quarter of all is counted.
                    held.append(s[: np.searchsorted(s, np.uint64(1 << 62))])
                    size += len(held[-1])
                    if size > 2_000_000:
                        yield often()
                        held, size = [], 0
            if n:
                ids, p = np.array(who, dtype=np.int64), np.stack(profiles)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), *(pa.array(p[:, i]) for i in range(len(PROFILE)))], names=names)
        yield often()

    return documents.select("key", "mark", "text").mapInArrow(tidy(run), "kind int, " + ", ".join(f"{c} long" for c in names[1:]))


def _entries(documents: DataFrame, order: Order, words: int, percent: int, salt: int) -> DataFrame:
    """The matrix entries within the size bounds: shingle, the row's class and size. Repeated sets of a worker count once."""
    shared = documents.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            parts, who, n = [], [], []
            for s in shingle_sets(batch.column(0), words):
                if not len(s) or (own := _identity(s, salt)[0]) in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(own)
                parts.append(shared.value.prefix(s, percent))
                who.append(own)
                n.append(len(s))
            if parts:
                sizes = [len(p) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.array(who, np.int64), sizes)), pa.array(np.repeat(np.array(n, np.int32), sizes))], names=["s", "id", "n"])

    return documents.select("text").mapInArrow(tidy(run), "s long, id long, n int")


def _shared_columns(entries: DataFrame, percent: int) -> DataFrame:
    """Entries of columns with another row whose size fits, each once. A stream: it holds one row of a column over to the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        fits = False  # whether the row that is held fits the one before it
        for batch in batches:
            s, a, n = (np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held))
            if not len(s):
                continue
            new = np.ones(len(s), dtype=bool)
            new[1:] = (s[1:] != s[:-1]) | (a[1:] != a[:-1])
            s, a, n = s[new], a[new], n[new]
            link = (s[1:] == s[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            keep = np.concatenate((link, [False])) | np.concatenate(([fits], link))
            out = np.flatnonzero(keep[:-1])
            held, fits = [s[-1:], a[-1:], n[-1:]], bool(keep[-1])
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (s, a, n)], names=["s", "id", "n"])
        if fits:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["s", "id", "n"])

    return entries.repartition("s").sortWithinPartitions("s", "n", "id").mapInArrow(tidy(run), "s long, id long, n int")


def _shared_bits(columns: DataFrame) -> np.ndarray:
    """A filter with a bit set for each column: eight bits a column, from 128 kB to 32 MB in all."""
    found = columns.select("s").distinct()
    size = min(28, max(20, int(8 * found.count() - 1).bit_length()))
    place = F.col("s").bitwiseAND(F.lit((1 << size) - 1))
    parts = found.select(F.shiftright(place, 15).alias("part"), place.bitwiseAND(F.lit(32_767)).alias("bit")).distinct().repartition("part")
    out = np.zeros(1 << (size - 3), dtype=np.uint8)
    for r in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        out[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 20_000, weight: int | None = None) -> Iterator[pa.Table]:
    """Cuts rows sorted by their first column into tables of at least ``rows`` rows (or of so much in the column ``weight``) that split no group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows if weight is None else int(batch.column(weight).to_numpy().sum())
        if size < rows or held[0].column(0)[0] == batch.column(0)[batch.num_rows - 1]:
            continue
        table = pa.Table.from_batches(held)
        key = table.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut)
        held = rest.combine_chunks().to_batches()
        size = rest.num_rows if weight is None else int(rest.column(weight).to_numpy().sum())
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _near(profile: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and profiles leave the pairs of rows ``x`` and ``y`` a chance. Alike enough means a symmetric
    difference of at most (100 - t) / (100 + t) of both sizes together, and profiles differ by no more than that."""
    good = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
    out = np.zeros(len(x), dtype=bool)
    at = np.flatnonzero(good)
    for i in range(0, len(at), 65_536):
        p = at[i : i + 65_536]
        apart = np.abs(profile[x[p]] - profile[y[p]]).sum(axis=1, dtype=np.int64)
        out[p] = (100 + percent) * apart <= (100 - percent) * (n[x[p]] + n[y[p]])
    return out


def _profiles(table: pa.Table, at: int) -> np.ndarray:
    words = np.stack([table.column(at + i).to_numpy() for i in range(len(PROFILE))], axis=1)
    return np.ascontiguousarray(words).view(np.uint8).astype(np.int16)


def _alive(columns: DataFrame, percent: int) -> DataFrame:
    """The entries whose column has another row with a chance, by size and profile; ``c`` is how many the column has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            s, a, size = (table.column(i).to_numpy() for i in range(3))
            n, profile = size.astype(np.int64), _profiles(table, 3)
            alive = np.zeros(len(s), dtype=bool)
            for gap in range(1, 9):  # rows come in the order of their sizes
                x = np.flatnonzero(s[gap:] == s[:-gap])
                if not len(x):
                    break
                x = x[~(alive[x] & alive[x + gap])]
                good = _near(profile, n, x, x + gap, percent)
                alive[x[good]] = alive[x[good] + gap] = True
            cuts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
            for k in np.flatnonzero(np.diff(cuts) > 9):
                i, j = cuts[k], cuts[k + 1]
                dead = i + np.flatnonzero(~alive[i:j])
                if len(dead) * int(j - i) > MOST_TESTS:  # an entry too many loses nothing
                    alive[i:j] = True
                    continue
                for x in dead:
                    low, high = i + np.searchsorted(n[i:j], [(percent * n[x] + 99) // 100, 100 * n[x] // percent + 1])
                    y = np.arange(low, high)
                    y = y[y != x]
                    if _near(profile, n, np.full(len(y), x), y, percent).any():
                        alive[x] = True
            c = np.repeat(np.add.reduceat(alive, cuts[:-1], dtype=np.int64), np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(x[alive]) for x in (s, a, size, c)], names=["s", "id", "n", "c"])

    return columns.select("s", "id", "n", *PROFILE).repartition("s").sortWithinPartitions("s", "n", "id").mapInArrow(tidy(run), "s long, id long, n int, c long")


def _sets(documents: DataFrame, words: int, salt: int) -> DataFrame:
    """``id`` and ``set`` (its shingles as bytes) of each row. Repeated sets of a worker count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, sets = [], []
            for s in shingle_sets(batch.column(0), words):
                own = _identity(s, salt)[0]
                if own not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(own)
                    ids.append(own)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "set"])

    return documents.select("text").mapInArrow(tidy(run), "id long, set binary")


def overlaps(first: np.ndarray, n: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The product of blocks with their transposes: pairs of rows with a common shingle, and how many they share. Block i has the
    rows ``first[i]:first[i + 1]``; ``value`` has their sets, one after the other, of the sizes ``n``."""
    m = np.diff(first)
    base = np.concatenate(([0], np.cumsum(m * m)))
    block = np.repeat(np.arange(len(m)), m)
    local = np.arange(len(n)) - first[:-1][block]
    owner = np.repeat(np.arange(len(n)), n)
    column = value ^ mix(np.arange(1, len(m) + 1, dtype=np.uint64))[block[owner]]
    by = np.argsort(column)
    column, owner = column[by], owner[by]
    start = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1]))) if len(column) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(column)))
    count = np.zeros(base[-1], dtype=np.int32)
    for size in range(2, LONG + 1):
        at = start[length == size]
        i, j = np.triu_indices(size, 1)
        step = max(1, 2_000_000 // len(i))
        for k in range(0, len(at), step):
            rows = np.sort(owner[at[k : k + step, None] + np.arange(size)], axis=1)
            u = block[rows[:, 0]]
            np.add.at(count, (base[u][:, None] + local[rows[:, i]] * m[u][:, None] + local[rows[:, j]]).ravel(), 1)
    at = np.flatnonzero(length > LONG)
    place = block[owner[start[at]]] if len(at) else at
    for u in np.unique(place):
        mine = at[place == u]
        total = np.zeros((m[u], m[u]), dtype=np.float32)
        for k in range(0, len(mine), TILE):
            part = mine[k : k + TILE]
            tile = np.zeros((m[u], len(part)), dtype=np.float32)
            for c, (a, b) in enumerate(zip(start[part].tolist(), (start[part] + length[part]).tolist())):
                tile[local[owner[a:b]], c] = 1
            total += tile @ tile.T
        count[base[u] : base[u + 1]] += np.triu(total, 1).astype(np.int32).ravel()
    code = np.flatnonzero(count)
    u = np.searchsorted(base, code, side="right") - 1
    return first[u] + (code - base[u]) // m[u], first[u] + (code - base[u]) % m[u], count[code]


def forest(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place connected with each of ``size`` places by links i - j."""
    label = np.arange(size)
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]


def _product(blocks: DataFrame, sets: DataFrame, percent: int, all_links: bool) -> DataFrame:
    """Links (``u``, ``v``) within blocks (rows ``unit``, ``id``, ``n``): all of them, or a spanning forest of each block's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, UNIT_ENTRIES // 2, weight=2):
            unit, a, n = table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).to_numpy().astype(np.int64)
            cuts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1], [True])))
            room = np.cumsum(np.diff(cuts) ** 2)
            k = 0
            while k < len(cuts) - 1:  # accumulators of some MB at a time
                stop = max(k + 1, int(np.searchsorted(room, (room[k - 1] if k else 0) + (1 << 23), side="right")))
                x, y = cuts[k], cuts[stop]
                value = np.frombuffer(b"".join(table.column(3).slice(x, y - x).to_pylist()), dtype=np.uint64)
                size = n[x:y]
                i, j, both = overlaps(cuts[k : stop + 1] - x, size, value)
                fine = (100 + percent) * both.astype(np.int64) >= percent * (size[i] + size[j])
                i, j, own = i[fine], j[fine], a[x:y]
                if not all_links:
                    root = forest(len(size), i, j)
                    i = np.flatnonzero(root != np.arange(len(root)))
                    j = root[i]
                u, v = own[i], own[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])
                k = stop

    whole = blocks.join(sets, "id").select("unit", "id", "n", "set")
    return whole.repartition("unit").sortWithinPartitions("unit", "id").mapInArrow(tidy(run), "u long, v long").filter("u <> v").distinct()


def _parts(entries: Column, rows: Column) -> Column:
    return F.greatest(F.ceil(entries / UNIT_ENTRIES), F.ceil(rows / UNIT_ROWS)).cast("int")


def _homes(entries: DataFrame) -> DataFrame:
    """``id``, ``n``, ``k`` and ``unit``, the row's block of kind ``k`` (null if it has that block for itself): by its longest column, and by its
    least columns by some hashes."""
    by = [F.max(F.least("c", F.lit(1 << 20)) * (1 << 40) + F.shiftrightunsigned(F.xxhash64("s"), 24)).alias("h0")] + [F.min(F.xxhash64(F.lit(k), "s")).alias(f"h{k}") for k in range(1, BLOCKS)]
    homes = entries.groupBy("id").agg(F.max("n").alias("n"), *by)
    dealt = homes.select("id", "n", F.posexplode(F.array(*(F.col(f"h{k}") for k in range(BLOCKS)))).alias("k", "h")).select("id", "n", "k", F.xxhash64("k", "h").alias("home"))
    weights = dealt.groupBy("home").agg(F.sum("n").alias("w"), F.count("*").alias("m")).filter("m > 1").select("home", "m", _parts(F.col("w"), F.col("m")).alias("g"))
    placed = lookup_join(dealt, weights, "home", "m", spread=F.xxhash64("id", "k"))
    unit = F.when(F.col("g") > 1, F.xxhash64("home", F.pmod(F.xxhash64("k", "id"), F.col("g")))).when(F.col("g") == 1, F.col("home"))
    return placed.select("id", "n", "k", unit.alias("unit"))


def _unmet(entries: DataFrame, classes: DataFrame, labels: DataFrame | None, units: DataFrame, percent: int) -> DataFrame:
    """The entries whose column has another row with a chance, of another component, that shared no block yet."""
    own = entries.select("s", "id", "n", "c")
    if labels is None:
        marked = own.withColumn("label", F.col("id"))
    else:
        marked = own.join(labels.withColumnRenamed("node", "id"), "id", "left").select("s", "id", "n", "c", F.coalesce("root", "id").alias("label"))
        mixed = marked.groupBy("s").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("s")
        marked = marked.join(mixed, "s", "left_semi")
    known = classes.select("id", *PROFILE).join(units.groupBy("id").agg(F.array_sort(F.collect_list(F.coalesce("unit", F.xxhash64("id", "k")))).alias("units")), "id")
    full = marked.join(known, "id").select("s", "id", "n", "c", "label", "units", *PROFILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            s, a, size, c, label = (table.column(i).to_numpy() for i in range(5))
            met = np.asarray(table.column(5).combine_chunks().flatten()).reshape(len(s), -1)
            n, profile = size.astype(np.int64), _profiles(table, 6)
            keep = np.zeros(len(s), dtype=bool)
            cuts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
            for i, j in zip(cuts, cuts[1:]):
                if (label[i:j] == label[i]).all():
                    continue
                if (j - i) ** 2 > MOST_TESTS:  # entries too many lose nothing
                    keep[i:j] = True
                    continue
                for x0 in range(i, j, 512):
                    x1 = min(j, x0 + 512)
                    apart = label[x0:x1, None] != label[None, i:j]
                    for k in range(met.shape[1]):
                        apart &= met[x0:x1, k, None] != met[None, i:j, k]
                    x, y = np.nonzero(apart)
                    x, y = x + x0, y + i
                    todo = ~(keep[x] & keep[y])
                    x, y = x[todo], y[todo]
                    good = _near(profile, n, x, y, percent)
                    keep[x[good]] = keep[y[good]] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (s, a, size, c)], names=["s", "id", "n", "c"])

    return full.repartition("s").sortWithinPartitions("s", "n", "id").mapInArrow(tidy(run), "s long, id long, n int, c long")


def _last_blocks(entries: DataFrame) -> DataFrame:
    """Blocks in which every two rows of a column meet. Columns that share rows hang together; where all rows of such a cluster, each
    once, are fewer entries than those of its columns, the cluster is one block (or one for every two of its parts)."""
    spark = entries.sparkSession
    heads = entries.groupBy("s").agg(F.min("id").alias("v"))
    roots = stored(connected_components(entries.select("s", F.col("id").alias("u")).join(heads, "s").select("u", "v").filter("u <> v").distinct()), "roots")
    placed = stored(entries.join(roots.withColumnRenamed("node", "id"), "id", "left").select("s", "id", "n", F.coalesce("root", "id").alias("root")), "placed")
    rows = stored(placed.select("root", "id", "n").distinct(), "rows")
    whole = rows.groupBy("root").agg(F.sum("n").alias("w"), F.count("*").alias("m")).select("root", "m", "w", _parts(F.col("w"), F.col("m")).alias("g"))
    columns = placed.groupBy("s", "root").agg(F.sum("n").alias("w"), F.count("*").alias("m")).select("s", "root", "m", "w", _parts(F.col("w"), F.col("m")).alias("g"))
    moved = columns.groupBy("root").agg(F.sum(F.col("w") * F.col("g")).alias("moved"))
    choice = stored(whole.join(moved, "root").select("root", "m", "g", (F.col("w") * F.col("g") <= F.col("moved")).alias("together")), "choice")

    def cut(frame: DataFrame, by: str) -> DataFrame:
        parted = frame.withColumn("p", F.pmod(F.xxhash64("id"), F.col("g")))
        each = parted.select(by, "id", "n", "p", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("q"))
        return each.select(F.xxhash64(F.lit(by), by, F.least("p", "q"), F.greatest("p", "q")).alias("unit"), "id", "n")

    together = lookup_join(rows, choice.filter("together").drop("together"), "root", "m", spread=F.col("id")).filter("g is not null")
    apart = columns.join(choice.filter("not together").select("root"), "root", "left_semi").select("s", "m", "g")
    single = lookup_join(placed.select("s", "id", "n"), apart, "s", "m", spread=F.col("id")).filter("g is not null")
    blocks = stored(cut(together, "root").unionByName(cut(single, "s")), "blocks")
    discard(spark, roots, placed, rows, choice, sweep=False)
    return blocks


class _Matrix:
    """What both joins start from: the rows, their sets' sizes and identities, and the classes of equal sets."""

    def __init__(self, documents: DataFrame, key: str, text: str, words: int, percent: int):
        self.spark, self.words, self.percent, self.salt = documents.sparkSession, words, percent, 0
        text_batches(self.spark)
        body = F.coalesce(F.col(text).cast("string"), F.lit(""))
        self.rows = documents.select(F.col(key).cast("long").alias("key"), F.xxhash64(body).alias("mark"), body.alias("text"))
        while True:  # two sets with one hash of 64 bits: never yet, but the second hash shows it, and another salt parts them
            self.survey = stored(_survey(self.rows, words, self.salt), "survey")
            self.signed = self.survey.filter("kind = 0").select("key", "mark", "n", "a")
            profile = [F.max(p).alias(p) for p in PROFILE]
            grouped = self.survey.filter("kind = 0 and n > 0 and key is not null").groupBy(F.col("a").alias("id"))
            self.classes = stored(grouped.agg(F.min("key").alias("rep"), F.count("*").alias("copies"), F.min("b").alias("x"), F.max("b").alias("y"), *profile), "classes")
            if self.classes.filter("x <> y").isEmpty():
                break
            discard(self.spark, self.survey, self.classes)
            self.salt += 1

    def links(self, all_links: bool) -> DataFrame:
        """Links between classes (stored): all, or enough to connect what is linked."""
        common = self.survey.filter("kind = 1").groupBy("a").agg(F.sum("b").alias("c")).orderBy(F.desc("c"), "a").limit(COMMON)
        frequent = [(r["a"], r["c"]) for r in common.collect()]
        keyed = self.rows.filter("key is not null")
        columns, bits = None, None
        for _ in range(2):  # the columns found first go to the end of the order: unlike rows meet in few of the second
            if columns is not None:
                bits = _shared_bits(columns)
                discard(self.spark, columns)
            columns = stored(_shared_columns(_entries(keyed, Order(frequent, bits), self.words, self.percent, self.salt), self.percent), "columns")
        entries = stored(_alive(columns.join(self.classes.select("id", *PROFILE), "id"), self.percent), "alive")
        discard(self.spark, columns)
        wanted = stored(entries.select("id").distinct().join(self.classes.select("id", "rep"), "id").select(F.col("rep").alias("key")).distinct(), "wanted")
        sets = stored(_sets(semi_join(keyed, [F.col("key")], wanted), self.words, self.salt), "sets")
        homes = stored(_homes(entries), "homes")
        links = stored(_product(homes.filter("unit is not null").select("unit", "id", "n"), sets, self.percent, all_links), "links")
        labels = None if all_links else stored(connected_components(links), "components")
        left = stored(_unmet(entries, self.classes, labels, homes, self.percent), "unmet")
        if not left.isEmpty():
            blocks = _last_blocks(left)
            more = stored(_product(blocks, sets, self.percent, all_links), "links")
            discard(self.spark, blocks, sweep=False)
            if all_links:
                links = stored(links.unionByName(more).distinct(), "links")
            else:
                labels = stored(connected_components(labels.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)), "components")
        discard(self.spark, wanted, sets, entries, homes, left)
        return links if all_links else labels.select(F.col("node").alias("u"), F.col("root").alias("v"))


def _answered(matrix: _Matrix, known: DataFrame) -> DataFrame:
    """The rows with what is known of their class (``id``, ``copies`` and more)."""
    signed = matrix.signed.withColumn("id", F.when(F.col("n") > 0, F.col("a")))
    return lookup_join(signed, known, "id", "copies", spread=F.xxhash64("key", "mark"))


def _components(documents: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """``key``, ``mark``, ``n`` and ``component_id`` of each row."""
    matrix = _Matrix(documents, key, text, words, percent)
    roots = matrix.links(all_links=False)
    members = roots.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
    members = stored(members.join(matrix.classes.select("id", "rep"), "id"), "members")
    least = members.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = matrix.classes.select("id", "rep", "copies").join(members.join(least, "root").select("id", "component_id"), "id", "left").select("id", "copies", F.coalesce("component_id", "rep").alias("component_id"))
    return _answered(matrix, known).select("key", "mark", "n", F.coalesce("component_id", "key").alias("component_id"))


def jaccard_components(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` (the smallest key reachable by links) of every row. Documents link when 100
    times the intersection of their shingle sets is at least ``percent`` times the union."""
    return _components(documents, key, text, words, percent).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def jaccard_links(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """The whole join. Pairs: ``class_id`` and ``other_id`` (the smaller first) of all classes of equal sets that link. Members: ``key``,
    ``n_shingles``, ``class_id`` (the smallest key with the same set; a row that links with nothing has its own) and ``n_links``,
    how many other rows a row links with, those of equal sets included. Classes whose rows share their smallest key share its id."""
    matrix = _Matrix(documents, key, text, words, percent)
    pairs, classes = matrix.links(all_links=True), matrix.classes.select("id", "rep", "copies")
    ends = pairs.select(F.col("u").alias("id"), F.col("v").alias("other")).unionByName(pairs.select(F.col("v").alias("id"), F.col("u").alias("other")))
    around = ends.join(classes.select(F.col("id").alias("other"), F.col("copies").alias("m")), "other").groupBy("id").agg(F.sum("m").alias("around"))
    known = classes.join(around, "id", "left").select("id", "copies", F.col("rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("around", F.lit(0))).alias("n_links"))
    links = F.when(F.col("key").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long")
    members = _answered(matrix, known).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("class_id", "key")).alias("class_id"), links.alias("n_links"))
    named = classes.select("id", "rep")
    pairs = pairs.join(named.select(F.col("id").alias("u"), F.col("rep").alias("x")), "u").join(named.select(F.col("id").alias("v"), F.col("rep").alias("y")), "v")
    return pairs.select(F.least("x", "y").alias("class_id"), F.greatest("x", "y").alias("other_id")), members


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` whose key is the smallest of its component. Only what is to go is joined with the rows. Rows that
    repeat both key and text stay or go together; rows without a key stay."""
    found = _components(documents, key, text, words, percent)
    gone = stored(found.filter("component_id < key").select("key", "mark").distinct(), "gone")
    return anti_join(documents, [F.col(key).cast("long"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))], gone)

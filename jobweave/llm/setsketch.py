"""Near-duplicates by SetSketch registers.

Each register keeps the smallest exponential draw over the set, truncated to a power of the base: sketches merge by maximum,
and two registers are equal about as often as the sets are similar.  Bands of registers find candidates, the joint likelihood
of which of two registers is larger estimates their similarity, and what passes is verified on the whole sets.

Equal sets are one node.  A bucket of a band is never expanded into all pairs.  Nodes meet one other node first, which joins
most near copies; members that are in one component need no test any more.  Of what is left, members of small buckets meet as
pairs; large buckets that share members are compared in tiles of two blocks of whole sets, each inside one task, in which only
members outside the largest component meet all others, and only links that join components leave a tile.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.common import attach, lowered, mixed, shipped, stored, table, without, word_hashes

SHINGLE = 2
STAGE_SHINGLE = 5
#: Links need 100 * shared >= PERCENT * united shingles.
PERCENT = 80
BANDS, ROWS = 66, 7
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Candidates whose estimate is this far below the threshold are not verified: more than six standard deviations.
MARGIN = 0.12
#: Rounds in which a node is tested against one other node only, members of a bucket that meet one center in such a round,
#: and members of a bucket up to which all pairs are tested afterwards; larger ones are compared in tiles.
QUICK_ROUNDS, QUICK_GROUP, CENTERS = 2, 32, 64
#: Members of one block of a tile and bytes of its sets, and distinct shingles that one matrix product takes.
BLOCK, BLOCK_BYTES, TILE_SHINGLES = 256, 16 << 20, 4096
#: Tables of up to this many rows of a few numbers are broadcast after they were counted.
SMALL_ROWS = 200_000
CHUNK_BYTES = 1 << 20
CHUNK_SHINGLES = 1 << 16


# ------------------------------------------------------------------------------------------------ sets and sketches


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Distinct 64-bit shingles of each text in order; a text of fewer words has one shingle, one without words none."""
    hashes, first, *_ = word_hashes(texts)
    factors = [np.uint64(pow(0x9FB21C651E98DF25, k + 1, 1 << 64)) for k in range(size)]
    all_runs = np.zeros(0, np.uint64)
    if len(hashes) >= size:
        sums = np.zeros(len(hashes) - size + 1, np.uint64)
        for k, factor in enumerate(factors):
            sums += mixed(hashes[k : len(hashes) - size + 1 + k] + np.uint64(k)) * factor
        all_runs = mixed(sums)
    out = []
    for low, high in zip(first[:-1], first[1:]):
        n = high - low
        if n >= size:
            out.append(np.unique(all_runs[low : high - size + 1]))
        elif n:
            whole = sum((int(h) + 1) * int(f) for h, f in zip(hashes[low:high], factors)) + int(n)
            out.append(mixed(np.array([whole % (1 << 64)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def register_seeds(registers: int) -> tuple[np.ndarray, np.ndarray]:
    place = np.arange(1, registers + 1, dtype=np.uint64)
    return mixed(place * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mixed(place * np.uint64(0xD6E8FEB86659FD93))


def sketches(sets: list[np.ndarray], registers: int = BANDS * ROWS) -> np.ndarray:
    """Registers of each set, one row a set; rows of empty sets are zero.  The sketch of a union is the maximum."""
    out = np.zeros((len(sets), registers), np.uint16)
    factors, masks = register_seeds(registers)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        own, size = [], 0
        while at < len(full) and (not own or size + len(sets[full[at]]) <= CHUNK_SHINGLES):
            own.append(full[at])
            size += len(sets[full[at]])
            at += 1
        items = np.concatenate([sets[i] for i in own])
        starts = np.cumsum([0] + [len(sets[i]) for i in own[:-1]])
        least = np.empty((registers, len(own)), np.uint64)
        for k in range(registers):
            least[k] = np.minimum.reduceat((items ^ masks[k]) * factors[k], starts)
        draw = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 2.0**-53)) / RATE
        out[own] = np.clip(np.floor(1 - np.log(draw) / np.log(BASE)), 0, TOP).astype(np.uint16).T
    return out


def band_hashes(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit number for each band of each sketch."""
    cut = registers.reshape(len(registers), bands, rows).astype(np.uint64)
    sums = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0xA24BAED4963EE407)
    for k in range(rows):
        sums = mixed(sums * np.uint64(0x9FB21C651E98DF25) + cut[:, :, k])
    return sums


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches: the most likely value, given the sizes of both sets, of how often a register
    of the first is larger, smaller or equal."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 201)[None, :] * most[:, None]
    chance = lambda x: -np.log(1 - np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p_more, p_less = chance(u[:, None] - v[:, None] * grid), chance(v[:, None] - u[:, None] * grid)
    log = lambda p: np.log(np.clip(p, 1e-12, 1))
    total = more[:, None] * log(p_more) + less[:, None] * log(p_less) + equal[:, None] * log(1 - p_more - p_less)
    return np.take_along_axis(grid, total.argmax(axis=1)[:, None], axis=1)[:, 0]


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Exact test on two sorted sets."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def text_chunks(texts: list[str | None]) -> Iterator[list[bytes]]:
    own, size = [], 0
    for text in map(lowered, texts):
        if own and size + len(text) > CHUNK_BYTES:
            yield own
            own, size = [], 0
        own.append(text)
        size += len(text)
    if own:
        yield own


def signatures(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), registers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for own in text_chunks(batch.column(1).to_pylist()):
                sets = shingle_sets(own, size)
                registers = sketches(sets, bands * rows)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                columns = [batch.column(0).slice(done, len(own)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in registers], pa.binary())]
                done += len(own)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "registers"])

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, n_shingles bigint, digest binary, registers binary")


def set_table(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, items: the whole sets of the documents that are nodes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for own in text_chunks(batch.column(1).to_pylist()):
                sets = [s.tobytes() for s in shingle_sets(own, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(own)), pa.array(sets, pa.binary())], ["node", "items"])
                done += len(own)

    wanted = nodes.select(F.col("node").alias("_node"))
    if wanted.limit(100_001).count() <= 100_000:
        wanted = F.broadcast(wanted)
    rows = docs.select("doc_id", "text")
    return rows.join(wanted, rows["doc_id"] == wanted["_node"], "left_semi").mapInArrow(build, f"node {kind}, items binary").dropDuplicates()


# ------------------------------------------------------------------------------------------------ components


def small(rows: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast if its count allows."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after links (a, b) are added; a component's label is its smallest one.

    Links between labels are contracted round by round: each label points to the smallest label that it meets, a pointer is
    followed once, and links within one label vanish.
    """
    own = small(labels)
    one = own.select(F.col("node").alias("a"), F.col("label").alias("x"))
    two = own.select(F.col("node").alias("b"), F.col("label").alias("y"))
    edges = stored(links.join(one, "a").join(two, "b").filter("x <> y").select("x", "y").distinct(), "edges")
    while edges.limit(1).count():
        both = edges.unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        points = stored(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("to")), "pointers")
        follow = small(points).select(F.col("x").alias("to"), F.col("to").alias("then"))
        points = stored(points.join(follow, "to", "left").select("x", F.coalesce("then", "to").alias("to")), "pointers")
        ends = small(points)
        moved = ends.select(F.col("x").alias("label"), "to")
        labels = stored(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        x, y = ends.select("x", F.col("to").alias("p")), ends.select(F.col("x").alias("y"), F.col("to").alias("q"))
        edges = stored(edges.join(x, "x").join(y, "y").filter("p <> q").select(F.col("p").alias("x"), F.col("q").alias("y")).distinct(), "edges")
    return labels


def buckets(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """hash, node, size of the buckets that hold two nodes or more."""
    kind = nodes.schema["node"].dataType.simpleString()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                registers = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, bands * rows)
                hashes = band_hashes(registers, bands, rows).view(np.int64).ravel()
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), bands)))
                yield pa.RecordBatch.from_arrays([pa.array(hashes), ids], ["hash", "node"])

    all_rows = nodes.select("node", "registers").mapInArrow(explode, f"hash bigint, node {kind}")
    shared = all_rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
    shared = stored(shared.filter("low <> high").select("hash", "n", F.col("n").alias("size")), "shared")
    return stored(attach(all_rows, shared, "hash", "n", ["node"], limit=1_000_000).filter("size IS NOT NULL").distinct(), "buckets")


def likely(pairs: DataFrame, nodes: DataFrame, registers: int, least: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity is at least `least`."""
    kind = nodes.schema["node"].dataType.simpleString()
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("registers").alias(f"r_{name}"), F.col("n_shingles").alias(f"n_{name}"))
    rows = side("a").join(small(pairs.select("a", "b")), "a").join(side("b"), "b").select("a", "b", "r_a", "r_b", "n_a", "n_b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                r_a, r_b = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(-1, registers) for i in (2, 3))
                n_a, n_b = (part.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (4, 5))
                good = pa.array(estimate(r_a, r_b, n_a, n_b) >= least)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], ["a", "b"])

    return stored(rows.mapInArrow(keep, f"a {kind}, b {kind}").distinct(), "likely")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the test on their whole sets (node, items).

    Few pairs are broadcast to the sets of their first nodes.  With many, a node with very many pairs is cut into pieces by
    its partners, and its set is copied once per piece.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    nodes = stored(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct(), "nodes")
    sets = sets.join(small(nodes), "node", "left_semi")
    side = lambda name: sets.select(F.col("node").alias(name), F.col("items").alias(f"s_{name}"))
    if pairs.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        rows = side("a").join(F.broadcast(pairs), "a").join(side("b"), "b")
    else:
        rows = pairs
        for name, other in (("a", "b"), ("b", "a")):
            counts = pairs.groupBy(name).agg(F.count("*").alias("n"))
            rows = attach(rows, side(name).join(counts, name), name, "n", [other], limit=0, target=20_000)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(i).to_pylist() for i in (2, 3))
            good = pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(one, two)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    return stored(rows.select("a", "b", "s_a", "s_b").mapInArrow(test, f"a {kind}, b {kind}").distinct(), "links")


def one_each(members: DataFrame, turn: int) -> DataFrame:
    """At most one pair (a, b) for each member: itself and a center of another label from one of its buckets.

    Buckets are cut into groups of about `QUICK_GROUP` members, other ones in each turn; each has one center.  In the first
    turn a bucket is one group, whose center is its smallest member.
    """
    pieces = F.ceil(F.col("size") / QUICK_GROUP).cast("int") if turn else F.lit(1)
    cut = members.withColumn("group", F.pmod(F.xxhash64("node", F.lit(turn)), pieces).cast("int"))
    draw = F.xxhash64("node", F.lit(turn)) if turn else F.col("node")
    centers = cut.groupBy("hash", "group").agg(F.min(F.struct(draw.alias("draw"), "node", "label")).alias("center"), F.count("*").alias("n"))
    centers = stored(centers.filter("n > 1").select(F.struct("hash", "group").alias("place"), "n", "center.node", "center.label"), "centers")
    centers = centers.select("place", "n", F.col("node").alias("other"), F.col("label").alias("own"))
    met = attach(cut.withColumn("place", F.struct("hash", "group")), centers, "place", "n", ["node"], limit=SMALL_ROWS).filter("label <> own")
    best = met.groupBy("node").agg(F.min_by("other", F.struct(F.xxhash64("hash", F.lit(turn)), "other") if turn else F.struct("other")).alias("other"))
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def all_pairs(members: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of members of other labels that share a bucket, without those of the largest label.

    Members of one of the `groups` (node, label) have met each other in tiles and are not paired again.
    """
    sizes = members.groupBy("hash", "label").agg(F.count("*").alias("n"))
    largest = stored(sizes.groupBy("hash").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.sum("n").alias("n")), "largest")
    if groups is None:
        members = members.withColumn("group", F.lit(None))
    else:
        members = members.join(small(groups.select("node", F.col("label").alias("group"))), "node", "left")
    minor = attach(members, largest, "hash", "n", ["node"], limit=SMALL_ROWS).filter("label <> largest")
    minor = minor.select("hash", F.col("node").alias("other"), F.col("label").alias("own"), F.col("group").alias("own_group"))
    met = members.join(minor, "hash").filter("label <> own AND NOT coalesce(group = own_group, false)")
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def joining_links(labels: list, sets: list[np.ndarray], outer: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(i, j) of similar sets, one for each pair of labels that such sets join.

    One of the two is marked in `outer`, the other one is not, or all are marked and all pairs count.
    """
    rows = np.flatnonzero(outer)
    columns = rows if outer.all() else np.flatnonzero(~outer)
    sizes = np.array([len(x) for x in sets])
    shingles, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(where, minlength=len(shingles)) > 1
    place = np.cumsum(shared) - 1
    mine = shared[where]
    owner, where = owner[mine], place[where[mine]]
    by = np.argsort(where, kind="stable")
    owner, where = owner[by], where[by]
    both = np.zeros((len(rows), len(columns)), np.float64)
    total = int(shared.sum())
    for low in range(0, total, TILE_SHINGLES):
        at = slice(*np.searchsorted(where, [low, low + TILE_SHINGLES]))
        has = np.zeros((len(sets), min(TILE_SHINGLES, total - low)), np.float32)
        has[owner[at], where[at] - low] = 1
        both += has[rows] @ has[columns].T
    _, number = np.unique(np.array(labels), return_inverse=True)
    good = 100 * both >= percent * (sizes[rows][:, None] + sizes[columns][None, :] - both)
    good &= number[rows][:, None] != number[columns][None, :]
    i, j = np.nonzero(good)
    _, first = np.unique(number[rows[i]] * (len(labels) + 1) + number[columns[j]], return_index=True)
    return [(int(rows[i[k]]), int(columns[j[k]])) for k in first]


def tile_links(members: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join the labels of `members` (hash, node, label) wherever buckets share members, and the groups
    (node, label) of buckets that share members.

    Every member outside the largest label of its group of buckets meets all others of the group, in tiles of two blocks; the
    number of blocks follows from the counted members and the bytes of their sets.
    """
    kind = members.schema["node"].dataType.simpleString()
    lows = stored(members.groupBy("hash").agg(F.min("node").alias("a")), "lows")
    nodes = stored(members.select("node", "label").distinct(), "members")
    meet = members.join(small(lows), "hash").select("a", F.col("node").alias("b")).filter("a <> b").distinct()
    groups = components(nodes.select("node", F.col("node").alias("label")), stored(meet, "meet"))
    placed = nodes.join(small(groups.select("node", F.col("label").alias("group"))), "node")
    sizes = stored(placed.groupBy("group", "label").agg(F.count("*").alias("n")), "sizes")
    largest = sizes.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    placed = placed.join(small(stored(largest, "largest")), "group").withColumn("outer", F.col("label") != F.col("largest")).drop("largest")
    rows = stored(placed.join(sets, "node"), "rows")
    needed = lambda side: F.greatest(F.ceil(F.count_if(side) / block), F.ceil(F.coalesce(F.sum(F.when(side, F.length("items"))), F.lit(0)) / BLOCK_BYTES)).cast("int")
    blocks = rows.groupBy("group").agg(needed(F.col("outer")).alias("n_outer"), needed(~F.col("outer")).alias("n_inner"))
    rows = rows.join(small(stored(blocks, "blocks")), "group")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("outer"), F.col("n_outer")).otherwise(F.col("n_inner"))).cast("int")
    every = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda inner, i, j: F.struct(F.lit(inner).alias("inner"), i.alias("i"), j.alias("j"))
    rows = rows.withColumn("own", own)
    among = F.transform(every(F.col("n_outer")), lambda j: tile(False, F.least(F.col("own"), j), F.greatest(F.col("own"), j)))
    against = F.transform(every(F.col("n_inner")), lambda j: tile(True, F.col("own"), j))
    inner = F.transform(every(F.col("n_outer")), lambda i: tile(True, i, F.col("own")))
    tiles = F.when(F.col("outer"), F.concat(among, against)).otherwise(inner)
    copies = rows.select("group", F.explode(tiles).alias("tile"), "node", "label", "outer", "items").select("group", "tile.inner", "tile.i", "tile.j", "node", "label", "outer", "items")

    def compare(part: pa.Table) -> pa.Table:
        outer = part.column("outer").to_numpy(zero_copy_only=False)
        found = []
        if outer.any() and len(outer) > 1 and not (part.column("inner")[0].as_py() and outer.all()):
            own_sets = [np.frombuffer(x, np.uint64) for x in part.column("items").to_pylist()]
            found = joining_links(part.column("label").to_pylist(), own_sets, outer, percent)
        node = part.column("node")
        pick = lambda k: node.take(pa.array([pair[k] for pair in found], pa.int64()))
        return pa.table([pick(0), pick(1)], ["a", "b"])

    return stored(copies.groupBy("group", "inner", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}"), "links"), groups


def labelled_nodes(nodes: DataFrame, docs: DataFrame, size: int, percent: int, bands: int, rows: int, centers: int) -> DataFrame:
    """node, label: the smallest node of its component, for all nodes that share a bucket with another one.

    After it, every pair in every bucket is tested or connected.  Buckets of one label are done.  The sets of the members are
    written once.
    """
    members = buckets(nodes, bands, rows)
    least = percent / 100 - MARGIN
    labels = stored(members.select("node").distinct().withColumn("label", F.col("node")), "labels")
    sets = stored(set_table(docs, labels, size), "sets")
    members, tested = members.withColumn("label", F.col("node")), None

    def still_open(members: DataFrame) -> DataFrame:
        marked = stored(members.drop("label").join(small(labels), "node"), "marked")
        open_ = marked.groupBy("hash").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
        open_ = stored(open_.select("hash", "n", F.col("n").alias("now")), "open")
        left = attach(marked, open_, "hash", "n", ["node"], limit=SMALL_ROWS).filter("now IS NOT NULL")
        return stored(left.select("hash", "node", F.col("now").alias("size"), "label"), "buckets")

    for turn in range(QUICK_ROUNDS + 1):
        pairs = one_each(members, turn)
        pairs = stored(pairs if tested is None else pairs.join(small(tested), ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else stored(tested.unionAll(pairs), "tested")
        labels = components(labels, verified(likely(pairs, nodes, bands * rows, least), sets, percent))
        members = still_open(members)
    large, groups = members.filter(F.col("size") > centers), None
    if large.limit(1).count():
        links, groups = tile_links(large, sets, percent)
        labels = components(labels, links)
        members = still_open(members.filter(F.col("size") <= centers))
    pairs = stored(all_pairs(members, groups).join(small(tested), ["a", "b"], "left_anti"), "pairs")
    return components(labels, verified(likely(pairs, nodes, bands * rows, least), sets, percent))


def grouped(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, centers: int = CENTERS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Two documents are linked if 100 * shared >= percent * united shingles; `component_id` is the smallest doc_id of the linked
    documents, `kept` marks it.  A pair at the threshold escapes all bands with a chance of about 1e-7, less above it; all
    links are verified.  Null, empty and word-free texts are linked with nothing.  Rows of one doc_id are one document: a link
    of any of them counts.  Rows without an id are linked with nothing and kept; their component is null.
    """
    shipped(docs.sparkSession)
    signed = stored(signatures(docs, size, bands, rows), "signatures")
    whole = signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    groups = stored(whole.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "groups")
    copies = attach(whole.select("doc_id", "digest"), groups.filter("n > 1"), "digest", "n", ["doc_id"]).filter("doc_id <> node")
    copies = stored(copies.select("doc_id", "digest"), "copies")
    nodes = whole.join(small(copies), ["doc_id", "digest"], "left_anti").select(F.col("doc_id").alias("node"), "n_shingles", "registers")
    labels = labelled_nodes(nodes, docs, size, percent, bands, rows, centers)
    lookup = groups.join(labels, "node", "left").select("digest", "n", F.coalesce("label", "node").alias("component_id"))
    by_row = attach(signed.select("doc_id", "n_shingles", "digest"), stored(lookup, "groups"), "digest", "n", ["doc_id"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    by_id = by_row.select("doc_id", "n_shingles", component.alias("component_id"))
    return by_id.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of near copies among all documents."""
    return grouped(table(spark, folder, "documents"))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies on shingles of five words."""
    found = stored(grouped(docs, STAGE_SHINGLE), "groups")
    return without(docs, found.filter("NOT kept"), "doc_id").select(*docs.columns)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+') IF x <> ''] AS a FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 1 THEN a ELSE [a[i] || ' ' || a[i + 1] FOR i IN range(1, len(a))] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, low) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.doc_id
), m AS (
  SELECT doc_id, min(low) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

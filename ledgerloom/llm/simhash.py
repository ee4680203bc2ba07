"""SimHash near-duplicates: exact comparison of fingerprints in tiles, and their connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_skewed, written

SEED = 42
#: Shingles whose bits are counted together.
COUNTED = 1 << 14


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit j is set if over half of the shingles' XXH64 have it; 0 without words."""
    words = text.lower().split()  # both ASCII only: A-Z and the six white space characters
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n], ends[-n:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, COUNTED):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + COUNTED].tolist(), ends[k : k + COUNTED].tolist())], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(batches: Iterator[pa.RecordBatch], text_col: str, name: str, shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column(text_col), "").cast(pa.large_string())
        prints = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), shingle) for t in texts), np.uint64, len(texts))
        rest = [c for c in batch.schema.names if c != text_col]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(prints.view(np.int64))], [*rest, name])


def key_masks(radius: int, n: int, per_key: int = 16) -> list[int]:
    """Masks of bits such that any two fingerprints within the radius agree on all bits of at least one mask.

    With b blocks of bits at most radius of them differ, so some b - radius agree. More blocks make
    longer keys, and so smaller groups, but more of them: the fewest that leave about per_key of n
    evenly spread fingerprints a key.
    """
    for blocks in range(radius + 1, 2 * radius + 3):
        edges = np.linspace(0, 64, blocks + 1).astype(int)
        parts = [sum(1 << j for j in range(a, b)) for a, b in zip(edges[:-1], edges[1:])]
        masks = [sum(c) for c in combinations(parts, blocks - radius)]
        if n <= per_key * 2 ** min(m.bit_count() for m in masks):
            break
    return masks


def near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one tile against another by exclusive-or and bit count, a few rows at a time."""
    rows, cols = [], []
    step = max(1, (1 << 18) // max(1, len(b)))
    for k in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[k : k + step, None] ^ b[None, :]) <= radius)
        rows.append(i + k)
        cols.append(j)
    return np.concatenate(rows), np.concatenate(cols)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it reaches by the links, by repeated minima and shortcuts."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            return label


def tile_pairs(unit: np.ndarray, ones: np.ndarray, radius: int, size: int) -> tuple[list[tuple[int, int]], int]:
    """Which tiles are compared: (first rows of) pairs of tiles, and how many pairs are skipped.

    Rows are sorted by unit and, in it, by bit count; each ``size`` of them are a tile. A tile is
    compared with itself, and with the later ones that its last unit goes on in while their bit
    counts differ by the radius at most.
    """
    starts = np.arange(0, len(unit), size)
    last = np.minimum(starts + size, len(unit)) - 1
    end = np.searchsorted(starts, np.searchsorted(unit, unit[last], side="right"))  # after the tiles with rows of that unit
    near_enough = np.array([i + 1 + np.searchsorted(ones[starts[i + 1 : e]], ones[z] + radius, side="right") for i, (z, e) in enumerate(zip(last, end))], np.int64)
    pairs = [(a, starts[j]) for i, a in enumerate(starts) for j in range(i, max(i + 1, near_enough[i]))]
    return pairs, int((end - np.maximum(near_enough, np.arange(1, len(starts) + 1))).clip(0).sum())


def tile_links(unit: np.ndarray, prints: np.ndarray, radius: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows that connect what all links within the compared tiles connect: at most one for each row.

    What a tile has of other units is compared as well: links are links, whichever unit they are found in.
    """
    i, j = [], []
    for a, b in tile_pairs(unit, np.bitwise_count(prints).astype(np.int64), radius, size)[0]:
        x, y = near(prints[a : a + size], prints[b : b + size], radius)
        own = a + x < b + y
        i.append(a + x[own])
        j.append(b + y[own])
    label = forest(len(prints), np.concatenate(i), np.concatenate(j))
    own = np.flatnonzero(label != np.arange(len(prints)))
    return label[own], own


def links(batches: Iterator[pa.RecordBatch], radius: int, size: int = 256) -> Iterator[pa.RecordBatch]:
    """(a, b) node links of a partition's units, which come sorted by unit and bit count; a unit's rows are held together."""

    def done(unit: np.ndarray, prints: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        i, j = tile_links(unit, prints.view(np.uint64), radius, size)
        return pa.RecordBatch.from_pydict({"a": node[i], "b": node[j]})

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in ("unit", "print", "node")])
        if sum(len(h[0]) for h in held) < 1 << 16:
            continue
        unit, prints, node = (np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(unit, unit[-1]))
        if cut:
            yield done(unit[:cut], prints[:cut], node[:cut])
        held = [[unit[cut:], prints[cut:], node[cut:]]]
    if held:
        yield done(*(np.concatenate(x) for x in zip(*held)))


def tiled(keyed: DataFrame, radius: int, tile: int) -> DataFrame:
    """The rows of (group, ones, node, ...) with the unit, in which what must be compared meets, in place of the group.

    A group is ordered by ``ones`` and, within one, by a hash of the node; each ``tile`` rows are a
    tile. A group of one tile is a unit. A larger one has a unit for each pair of its tiles whose
    ``ones`` differ by the radius at most.
    """
    counts = keyed.groupBy("group", "ones").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("group").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile).cast("int")))).alias("tiles"))
    groups = written(groups.filter(F.col("n") > tile), "simhash-groups")
    none = F.array().cast("array<struct<ones:int,tile:int>>")
    others = F.flatten(
        F.transform(
            F.sequence(F.col("ones") - radius, F.col("ones") + radius),
            lambda o: F.when(
                F.try_element_at("tiles", o).isNotNull(), F.transform(F.sequence(F.lit(0), F.try_element_at("tiles", o) - 1), lambda t: F.struct(o.alias("ones"), t.alias("tile")))
            ).otherwise(none),
        )
    )
    joined = join_skewed(keyed, groups, "group", "n")
    own = F.struct(F.col("ones").alias("ones"), F.pmod(F.xxhash64("node"), F.coalesce(F.try_element_at("tiles", F.col("ones")), F.lit(1))).cast("int").alias("tile"))
    joined = joined.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("tiles").isNull(), F.array("own")).otherwise(others)))
    alone = F.struct(F.lit(-1).alias("ones"), F.lit(0).alias("tile"))
    pair = [F.when(F.col("tiles").isNull(), alone).otherwise(f("own", "other")) for f in (F.least, F.greatest)]
    return joined.select(F.xxhash64("group", *pair).alias("unit"), *[c for c in keyed.columns if c != "group"])


def units(nodes: DataFrame, radius: int, tile: int, n: int) -> DataFrame:
    """(unit, ones, print, node): what is compared with what. Fingerprints with the same bits under a mask are a group, ordered by bit count."""
    masks = key_masks(radius, n)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("print", "node", F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.lit(m).cast("bigint").alias("bits")) for k, m in enumerate(signed)])).alias("m")).select(
        F.xxhash64("m.mask", F.col("print").bitwiseAND(F.col("m.bits"))).alias("group"), F.bit_count("print").cast("int").alias("ones"), "print", "node"
    )
    return tiled(keyed, radius, tile)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the links (a, b) reaches.

    Alternates two steps until nothing changes: each node sends its larger neighbours to the smallest
    one it knows, then its smaller ones. Every step is a minimum by node, summed before its shuffle, and
    a join in which a node with very many links is broadcast; the links are written after each round.
    """

    def round_of(links: DataFrame, larger: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else links
        low = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"), F.count(F.lit(1)).alias("n")), "simhash-low")
        joined = join_skewed(both, low, "a", "n")
        if larger:
            return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        return moved.filter(F.col("a") != F.col("b")).distinct()

    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = written(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "simhash-links")
    seen = state(links)
    while True:
        links = written(round_of(written(round_of(links, True), "simhash-links"), False), "simhash-links")
        now = state(links)
        if now == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now


def simhash_components(
    docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", tile: int = 4096
) -> DataFrame:
    """The fingerprint and the near-duplicate component of each id.

    A fingerprint is of all shingles of ``shingle`` words of the whole text, repeats included; a text
    with fewer words is one shingle, one without words (null, empty, blank) has the fingerprint zero
    and links like any other. Fingerprints with up to ``radius`` different bits are linked; a
    component is what links reach, its id the smallest id in it. Returns id_col, fingerprint (16
    hexadecimal digits) and component_id, one row per row of docs, repeated rows included. Ids are
    integers; a row without id has a fingerprint and, where ids reach it, their component, else
    null. An empty table gives no rows.

    Equal fingerprints are one node, so copies are compared once. Exact: any pair within the radius
    shares the bits of at least one mask of key_masks, so the masks only order the fingerprints; they
    are compared in tiles by exclusive-or and bit counts, and tile pairs whose bit counts are too far
    apart are skipped. Only links that connect something new within the tiles that a task holds are
    kept, so a dense group gives about as many as it has members, not their square.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = written(own.mapInArrow(lambda batches: fingerprints(batches, "text", "print", shingle), "id long, print long"), "simhash-prints")
    nodes = written(prints.groupBy("print").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    compared = units(nodes.select("print", F.col("print").alias("node")), radius, tile, nodes.count())
    found = compared.repartition("unit").sortWithinPartitions("unit", "ones").select("unit", "print", "node").mapInArrow(lambda batches: links(batches, radius), "a long, b long")
    of_print = components(found)
    # A component's root is a fingerprint; its id is the smallest one of its fingerprints.
    rooted = nodes.join(of_print, nodes["print"] == of_print["node"], "left").select("print", "id", "n", F.coalesce("component", "print").alias("root"))
    rooted = written(rooted, "simhash-rooted")
    ids = written(rooted.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("prints")), "simhash-components")
    classes = written(join_skewed(rooted.select("print", "n", "root"), ids, "root", "prints").select("print", "n", "component_id"), "simhash-classes")
    found = join_skewed(prints, classes, "print", "n")
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")

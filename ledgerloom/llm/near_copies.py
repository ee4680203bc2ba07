"""Near copies by SimHash fingerprints and a prefix filter on rare shingles, checked by the exact Jaccard similarity; components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_of, written
from .simhash import SEED, components, fingerprint, forest, links as print_links, tiled, units

#: Counts of shingles by this many buckets of hashes order the shingles, rare ones first.
BUCKETS = 1 << 20
#: Bits in which fingerprints that are compared may differ, and rows of a tile of them.
RADIUS, PRINT_TILE = 3, 4096
#: Rows of a shingle up to which its pairs are listed; rows of more are compared in tiles of so many, by so many shingles at once.
LISTED, TILE, WIDE = 32, 512, 2048


def shingle_set(text: str, shingle: int) -> set[bytes]:
    """The distinct shingles of a text; one with fewer words, or without any, is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII only, as in simhash.fingerprint
    return {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))}


def hashes(text: str, shingle: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in shingle_set(text, shingle)], np.uint64))


def similar(a: set[bytes], b: set[bytes], least: tuple[int, int]) -> bool:
    common = len(a & b)
    return common * least[1] >= least[0] * (len(a) + len(b) - common)


def sizes_allow(a: np.ndarray, b: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    return np.minimum(a, b) * least[1] >= least[0] * np.maximum(a, b)


def signature(h: np.ndarray) -> bytes:
    """Bits that tell for each class of hashes whether the set has an odd number of them; at least twice as many as the set has hashes."""
    bits = max(64, 1 << (2 * len(h) - 1).bit_length())
    parity = np.bincount((h >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


class Signatures:
    """Signatures of several lengths by their place. Longer ones are folded to the length of those that they meet."""

    def __init__(self, data: list[bytes]):
        self.length = np.array([len(x) for x in data], np.int64)
        self.place = np.zeros(len(data), np.int64)
        self.folded: dict[tuple[int, int], np.ndarray] = {}
        for n in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == n)
            self.place[at] = np.arange(len(at))
            self.folded[n, n] = np.frombuffer(b"".join(data[k] for k in at), np.uint64).reshape(len(at), -1)

    def of(self, rows: np.ndarray, n: int) -> np.ndarray:
        out = np.empty((len(rows), n // 8), np.uint64)
        length = self.length[rows]
        for own in np.unique(length).tolist():
            if (own, n) not in self.folded:
                self.folded[own, n] = np.bitwise_xor.reduce(self.folded[own, own].reshape(-1, own // n, n // 8), axis=1)
            out[length == own] = self.folded[own, n][self.place[rows[length == own]]]
        return out

    def allow(self, size: np.ndarray, i: np.ndarray, j: np.ndarray, least: tuple[int, int]) -> np.ndarray:
        """Which pairs may reach the least similarity: sets differ in at least as many hashes as their signatures in bits."""
        out = np.zeros(len(i), bool)
        shorter = np.minimum(self.length[i], self.length[j])
        for n in np.unique(shorter).tolist():
            own = np.flatnonzero(shorter == n)
            step = max(1, (1 << 22) // n)
            for k in range(0, len(own), step):
                at = own[k : k + step]
                differ = np.bitwise_count(self.of(i[at], n) ^ self.of(j[at], n)).sum(axis=1, dtype=np.int64)
                out[at] = differ * (least[0] + least[1]) <= (size[i[at]] + size[j[at]]) * (least[1] - least[0])
        return out


def sketches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(row, size, print, signature): a text's number of distinct shingles, its SimHash fingerprint and its signature."""
    for batch in batches:
        sizes, prints, signatures = [], [], []
        for text in batch.column("text"):
            h = hashes(text.as_py(), shingle)
            sizes.append(len(h))
            signatures.append(signature(h))
            prints.append(fingerprint(text.as_py().encode("utf-8", "surrogatepass"), shingle))
        columns = [batch.column("row"), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(signatures, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "size", "print", "signature"])


def bucket_counts(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in batch.column("text"):
            np.add.at(counts, (hashes(text.as_py(), shingle) % BUCKETS).astype(np.int64), 1)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"bucket": seen, "n": counts[seen]})


def prefixes(batches: Iterator[pa.RecordBatch], shingle: int, least: tuple[int, int], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, row, size): of each text the first shingles in the order of all texts, so many that texts of the least similarity share one."""
    for batch in batches:
        keys, rows, sizes = [], [], []
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
            h = hashes(text.as_py(), shingle)
            own = h[np.lexsort((h, counts[(h % BUCKETS).astype(np.int64)]))][: len(h) + -len(h) * least[0] // least[1] + 1]
            keys.append(own.view(np.int64))
            rows.append(np.full(len(own), row, np.int64))
            sizes.append(np.full(len(own), len(h), np.int64))
        if keys:
            yield pa.RecordBatch.from_pydict({"key": np.concatenate(keys), "row": np.concatenate(rows), "size": np.concatenate(sizes)})


def by_key(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Columns in runs of whole keys, without keys of one row; the rows come sorted by key."""

    def shared(columns: list[np.ndarray]) -> list[np.ndarray]:
        key = columns[0]
        new = np.r_[True, key[1:] != key[:-1], True]
        several = ~(new[:-1] & new[1:])
        return [c[several] for c in columns]

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        if held[-1][0][0] == held[-1][0][-1] == held[0][0][0]:
            continue  # still within one key
        columns = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        yield shared([c[:cut] for c in columns])
        held = [[c[cut:] for c in columns]]
    if held:
        yield shared([np.concatenate(c) for c in zip(*held)])


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, row, size in by_key(batches, ("key", "row", "size")):
        yield pa.RecordBatch.from_pydict({"key": key, "row": row, "size": size})


def pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_pydict({"a": pairs[0], "b": pairs[1]})


def first_pairs(batches: Iterator[pa.RecordBatch], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Each row of a key with the key's first row and with the next one by size: as many pairs as rows, twice."""
    for key, row, size in by_key(batches, ("key", "row", "size")):
        at = np.flatnonzero(key[1:] == key[:-1]) + 1
        first = np.searchsorted(key, key[at])
        i, j = np.r_[at, at], np.r_[first, at - 1]
        close = sizes_allow(size[i], size[j], least)
        yield pair_batch(row[i[close]], row[j[close]])


def other_pairs(batches: Iterator[pa.RecordBatch], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """All pairs of a key's rows that aren't in one component yet and that their signatures allow."""
    for key, row, size, label, data in by_key(batches, ("key", "row", "size", "label", "signature")):
        if not len(key):
            continue
        group = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, group, label)
        np.maximum.at(high, group, label)
        open_ = (low != high)[group]
        key, row, size, label, known = key[open_], row[open_], size[open_], label[open_], Signatures(data[open_].tolist())
        at, d = np.arange(len(key)), 0
        while True:
            d += 1
            at = at[at + d < len(key)]
            at = at[(key[at] == key[at + d]) & sizes_allow(size[at], size[at + d], least)]  # sorted by size: later ones are farther
            if not len(at):
                break
            apart = at[label[at] != label[at + d]]
            apart = apart[known.allow(size, apart, apart + d, least)]
            if len(apart):
                yield pair_batch(row[apart], row[apart + d])


def allowed(batches: Iterator[pa.RecordBatch], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) that sizes and signatures allow."""
    for batch in batches:
        n, known = batch.num_rows, Signatures(batch.column("signature_a").to_pylist() + batch.column("signature_b").to_pylist())
        size = np.concatenate([batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()])
        i = np.arange(n)
        close = known.allow(size, i, i + n, least) & sizes_allow(size[:n], size[n:], least)
        yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))


def promising(batches: Iterator[pa.RecordBatch], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(unit, row, label) of the rows that their signatures allow to be linked to one of another component in the unit."""
    names = ("unit", "row", "size", "label", "signature")

    def done(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        unit, row, size, label, data = (np.concatenate(c) for c in zip(*held))
        known, i = Signatures(data.tolist()), np.arange(len(row))
        found = np.zeros(len(row), bool)
        for k in range(len(row) - 1):
            later = i[k + 1 :]
            later = later[(label[later] != label[k]) & sizes_allow(size[later], size[k], least)]
            later = later[known.allow(size, np.full(len(later), k), later, least)]
            found[later] = True
            found[k] |= len(later) > 0
        return pa.RecordBatch.from_pydict({"unit": unit[found], "row": row[found], "label": label[found]})

    unit, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        cuts = np.r_[0, np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1, batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and columns[0][a] != unit:
                yield done(held)
                held = []
            unit = columns[0][a]
            held.append([c[a:b] for c in columns])
    if held:
        yield done(held)


def verified(batches: Iterator[pa.RecordBatch], shingle: int, least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = zip(batch.column("text_a"), batch.column("text_b"))
        kept = [similar(shingle_set(a.as_py(), shingle), shingle_set(b.as_py(), shingle), least) for a, b in texts]
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def shingle_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [hashes(t.as_py(), shingle).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("row"), batch.column("label"), pa.array(sets, pa.binary())], ["unit", "row", "label", "shingles"])


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets have in common: a product of their incidence matrix, some columns at a time."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1
    own = n[column] > 1
    row, column = row[own], number[column[own]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(number[-1]) + 1 if len(number) else 0, WIDE):
        a, b = np.searchsorted(column, (k, k + WIDE))
        part = np.zeros((len(sets), WIDE), np.float32)
        part[row[a:b], column[a:b] - k] = 1
        out += part @ part.T
    return out


def unit_links(batches: Iterator[pa.RecordBatch], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Links of units, whose rows come one after the other, that connect what isn't in one component yet: at most one for each row."""

    def done(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        rows, labels = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
        sizes = np.array([len(h[2]) for h in held], np.float32)
        common = common_shingles([h[2] for h in held])
        i, j = np.nonzero((common * least[1] >= least[0] * (sizes[:, None] + sizes[None, :] - common)) & (labels[:, None] != labels[None, :]))
        label = forest(len(rows), i, j)
        own = np.flatnonzero(label != np.arange(len(rows)))
        return pa.RecordBatch.from_pydict({"a": rows[label[own]], "b": rows[own]})

    unit, held = None, []
    for batch in batches:
        for u, row, label, data in zip(*(batch.column(c).to_pylist() for c in ("unit", "row", "label", "shingles"))):
            if held and u != unit:
                yield done(held)
                held = []
            unit = u
            held.append((row, label, np.frombuffer(data, np.uint64)))
    if held:
        yield done(held)


def print_pairs(known: DataFrame) -> DataFrame:
    """(a, b): rows that SimHash links, of known (row, print, ...): those of one fingerprint, and the first ones of two within the radius."""
    nodes = written(known.groupBy("print").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")), "near-prints")
    compared = units(nodes.select("print", F.col("print").alias("node")), RADIUS, PRINT_TILE, nodes.count())
    found = compared.repartition("unit").sortWithinPartitions("unit", "ones").select("unit", "print", "node").mapInArrow(lambda b: print_links(b, RADIUS), "a long, b long").filter("a <> b").distinct()
    first = nodes.select("print", "first")
    between = found.join(first.toDF("a", "row_a"), "a").join(first.toDF("b", "row_b"), "b").select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b"))
    copies = known.select("print", "row").join(nodes.filter("n > 1").select("print", "first"), "print").filter("row > first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    return between.unionByName(copies)


def near_components(texts: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """(node, component) of the rows of texts (row, text; text not null) that are linked to smaller ones."""
    spark = texts.sparkSession
    sketch = written(texts.mapInArrow(lambda b: sketches(b, shingle), "row long, size long, print long, signature binary"), "near-sketches")
    counted = texts.mapInArrow(lambda b: bucket_counts(b, shingle), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    known = spark.sparkContext.broadcast(counts)
    keyed = texts.mapInArrow(lambda b: prefixes(b, shingle, least, known.value), "key long, row long, size long")
    shared = written(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(shared_keys, keyed.schema), "near-keys")

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs whose texts are similar. Only texts of pairs that may be are fetched."""
        both = written(pairs, "near-pairs")
        own = written(texts.join(both.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "row", "left_semi"), "near-texts")
        both = both.join(own.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a").join(own.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
        return written(both.select("a", "b", "text_a", "text_b").mapInArrow(lambda b: verified(b, shingle, least), "a long, b long"), "near-links")

    def by_keys(keys: DataFrame, pairs_of: Callable[[Iterator[pa.RecordBatch], tuple[int, int]], Iterator[pa.RecordBatch]]) -> DataFrame:
        return keys.repartition("key").sortWithinPartitions("key", "size", "row").mapInArrow(lambda b: pairs_of(b, least), "a long, b long").distinct()

    # What SimHash links, and each row with two others of its shingles.
    pairs = print_pairs(sketch).unionByName(by_keys(shared, first_pairs)).distinct()
    for c in ("a", "b"):
        pairs = pairs.join(sketch.select(F.col("row").alias(c), F.col("size").alias(f"size_{c}"), F.col("signature").alias(f"signature_{c}")), c)
    first = components(checked(pairs.mapInArrow(lambda b: allowed(b, least), "a long, b long")))
    labelled = shared.join(first.withColumnRenamed("node", "row"), "row", "left").select("key", "row", "size", F.coalesce("component", "row").alias("label"))
    labelled = written(labelled, "near-labelled")
    keys = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    keys = written(keys.select("key", (F.col("n") > LISTED).alias("many")), "near-open")
    signatures = sketch.select("row", "signature")
    few = checked(by_keys(labelled.join(keys.filter("NOT many"), "key", "left_semi").join(signatures, "row"), other_pairs))

    # Rows that meet under shingles of many rows are a group, compared in tiles of texts of about one size.
    large = labelled.join(keys.filter("many"), "key", "left_semi")
    large = written(large.select("row", "label", "size", F.xxhash64(F.lit("row"), "row").alias("a"), F.xxhash64(F.lit("key"), "key").alias("b")), "near-large")
    of_node = components(large.select("a", "b"))
    rows = large.groupBy("a").agg(*[F.first(c).alias(c) for c in ("row", "label", "size")]).join(of_node.withColumnRenamed("node", "a"), "a", "left")
    step = math.log(least[1] / least[0]) + 1e-9  # texts that can be linked are of the same class of sizes or of the next one
    rows = rows.select(F.coalesce("component", "a").alias("group"), F.floor(F.ln("size") / step).cast("int").alias("ones"), F.col("row").alias("node"), "label", "size")
    compared = tiled(written(rows, "near-groups"), 1, TILE).select("unit", F.col("node").alias("row"), "label", "size").join(signatures, "row")
    shape = "unit long, row long, label long"
    compared = written(compared.repartition("unit").sortWithinPartitions("unit").mapInArrow(lambda b: promising(b, least), shape), "near-promising")
    sets = compared.join(texts, "row").mapInArrow(lambda b: shingle_rows(b, shingle), "unit long, row long, label long, shingles binary")
    many = sets.repartition("unit").sortWithinPartitions("unit").mapInArrow(lambda b: unit_links(b, least), "a long, b long")
    more = written(few.unionByName(many), "near-links")
    if more.isEmpty():
        return first
    return components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def one_of_each(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each component the row with the smallest id, null last.

    Two texts are linked if the Jaccard similarity of their sets of ``shingle`` words is at least the
    fraction ``least``; a component is what links reach. Words are as in simhash. Rows are told apart
    by a number, so null and repeated ids are rows like any other. Null texts are empty texts, and
    texts without words are copies of each other. An empty table gives no rows.

    First SimHash links texts, by fingerprints of the same shingles that differ in up to RADIUS bits
    (those of simhash, in tiles), and an exact check of the words follows. A text that misses the radius
    may still be similar, so all other pairs are found too: shingles have one order for all texts (rare ones first, by counts of
    hash buckets), and two texts of the least similarity share one of their first shingles. What
    shares one is compared: at first each row with two others of its shingle, by the words themselves,
    then what isn't in one component yet. Of shingles of few rows those pairs are listed; rows that meet
    under shingles of many are a group, which is compared in tiles by numpy, exactly by the hashes of
    all shingles, and gives no more links than rows. Before texts or sets of hashes are fetched, parity signatures
    of 2 to 4 bits a shingle drop most pairs that can't be similar, and none that can: so what is listed grows with
    the input and not with the square of a group.
    """
    n = fresh(docs, "row", "id")
    identity = F.col(id_col).cast("bigint")
    if docs.groupBy(identity.alias("id")).count().filter("count > 1 OR id IS NULL").isEmpty():
        docs = docs.withColumn(n["row"], identity)
    else:  # a number tells the rows apart, fixed by writing it once
        docs = written(docs.withColumn(n["row"], F.monotonically_increasing_id()), "near-numbered")
    found = near_components(docs.select(F.col(n["row"]).alias("row"), text_of(F.col(text_col).cast("string")).alias("text")), shingle, least)
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())  # the smallest nodes themselves
    of_row = docs.select(F.col(n["row"]).alias("node"), identity.alias("id")).join(found, "node")
    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("node"))
    first = of_row.groupBy("component").agg(F.min(rank).alias("first"))
    gone = of_row.join(first, "component").filter(rank != F.col("first")).select(F.col("node").alias(n["id"]))
    return docs.join(gone, docs[n["row"]] == gone[n["id"]], "left_anti").drop(n["row"])

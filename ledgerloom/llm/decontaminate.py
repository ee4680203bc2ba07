"""Benchmark decontamination: exact windows of benchmark items in documents by a prefix-filtered join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, without, written
from .words import LOWER, Lookup, chunks, runs, word_bounds, word_hashes

#: Words of a shingle, the token of the join.
SHINGLE = 3
#: Parts of a window's items, so that one which very many items share is in several blocks.
PARTS = 64
ADDED = ("n_words", "n_hit", "items", "contaminated")


@dataclass
class Block:
    """Benchmark windows, and by necessary token the windows to verify."""

    spelled: list[bytes]  # of each window: its words, space-joined
    items: list[list[str]]  # of each window: the items that have it
    length: np.ndarray  # of each window: its words
    whole: np.ndarray  # of each window: the hash of all its words
    tokens: dict[int, Lookup]  # by words of a token: the necessary ones
    first: dict[int, np.ndarray]  # of each of those: its first posting
    window: dict[int, np.ndarray]  # postings: the window,
    at: dict[int, np.ndarray]  # and the token's place in it


def spelled_windows(batches: Iterator[pa.RecordBatch], size: int, id_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    """(window, item) of each window of each item: size consecutive words, or all of a shorter item."""
    for batch in batches:
        ids = batch.column(id_col).cast(pa.string()).to_pylist()
        out: list[tuple[str, str]] = []
        for row, data, offsets in chunks(batch.column(text_col)):
            data = LOWER[data]
            starts, ends, first = word_bounds(data, offsets)
            for k in range(len(offsets) - 1):
                a, b = int(first[k]), int(first[k + 1])
                words = [data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b])]
                for i in range(max(1, len(words) - size + 1) if words else 0):
                    out.append((" ".join(words[i : i + size]), ids[row + k] or ""))
        yield pa.RecordBatch.from_pydict({"window": pa.array([w for w, _ in out], pa.string()), "item": pa.array([i for _, i in out], pa.string())})


def hashed(window: bytes) -> tuple[np.ndarray, np.uint64, np.ndarray]:
    """Hashes of a window's words, of all of them together, and of its tokens."""
    data = np.frombuffer(window, np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    words = word_hashes(data, starts, ends)
    return words, runs(words, len(words))[0], runs(words, min(SHINGLE, len(words)))


def vocabulary(windows: list[str]) -> dict[int, Lookup]:
    """All tokens of windows by their number of words."""
    tokens: dict[int, list[np.ndarray]] = {}
    for w in windows:
        words, _, own = hashed(w.encode())
        tokens.setdefault(min(SHINGLE, len(words)), []).append(own)
    return {n: Lookup(np.unique(np.concatenate(t))) for n, t in tokens.items()}


def count_tokens(batches: Iterator[pa.RecordBatch], known: dict[int, Lookup], text_col: str) -> Iterator[pa.RecordBatch]:
    """How often the known tokens occur in the texts of a partition."""
    counts = {n: np.zeros(len(v.keys), np.int64) for n, v in known.items()}
    for batch in batches:
        for _, data, offsets in chunks(batch.column(text_col)):
            data = LOWER[data]
            starts, ends, _ = word_bounds(data, offsets)
            h = word_hashes(data, starts, ends)
            for n, v in known.items():
                counts[n] += np.bincount(v.find(runs(h, n))[1], minlength=len(v.keys))
    for n, v in known.items():
        seen = counts[n] > 0
        yield pa.RecordBatch.from_pydict({"token": v.keys[seen].view(np.int64), "n": counts[n][seen]})


def build(windows: list[tuple[str, list[str]]], rarity: dict[int, int]) -> Block:
    """The join's index. All of a window's tokens must occur, so its rarest one is the whole necessary prefix."""
    spelled, items = [w.encode() for w, _ in windows], [i for _, i in windows]
    words, whole, tokens = zip(*map(hashed, spelled))
    length = np.array([len(w) for w in words])
    chosen = np.array([min(range(len(t)), key=lambda k: (rarity.get(int(t[k].view(np.int64)), 0), int(t[k]))) for t in tokens])
    key = np.array([t[k] for t, k in zip(tokens, chosen)], np.uint64)
    out = Block(spelled, items, length, np.array(whole, np.uint64), {}, {}, {}, {})
    for n in np.unique(np.minimum(length, SHINGLE)).tolist():
        own = np.flatnonzero(np.minimum(length, SHINGLE) == n)
        own = own[np.argsort(key[own], kind="stable")]
        keys, first = np.unique(key[own], return_index=True)
        out.tokens[n], out.first[n], out.window[n], out.at[n] = Lookup(keys), np.append(first, len(own)), own, chosen[own]
    return out


def occurrences(block: Block, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, its first word's number) of each place where a window stands in a text.

    A candidate is a text's token that is a window's necessary one. It stands if the window lies
    inside the text around it (length and position bounds) and all words are equal: by the hash of
    all, then by their bytes.
    """
    h = word_hashes(data, starts, ends)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    for n, lookup in block.tokens.items():
        place, key = lookup.find(runs(h, n))
        if not len(place):
            continue
        reps = block.first[n][key + 1] - block.first[n][key]
        posting = np.repeat(block.first[n][key] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
        place = np.repeat(place, reps)
        window, begin = block.window[n][posting], place - block.at[n][posting]
        text = np.searchsorted(first, place, side="right") - 1
        inside = (begin >= first[text]) & (begin + block.length[window] <= first[text + 1])
        window, begin = window[inside], begin[inside]
        for size in np.unique(block.length[window]).tolist():
            own = np.flatnonzero(block.length[window] == size)
            own = own[runs(h, size)[begin[own]] == block.whole[window[own]]]
            spelled = (b" ".join(data[s:e].tobytes() for s, e in zip(starts[i : i + size], ends[i : i + size])) for i in begin[own].tolist())
            same = np.fromiter((x == block.spelled[w] for x, w in zip(spelled, window[own].tolist())), bool, len(own))
            found.append((window[own][same], begin[own][same]))
    return np.concatenate([w for w, _ in found]), np.concatenate([b for _, b in found])


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Sorted disjoint half-open spans with the same union."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def mark(batches: Iterator[pa.RecordBatch], block: Block, text_col: str, names: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Add to each row its words, the spans of words hit and the items; join them to what an earlier block has found."""
    for batch in batches:
        words, spans, items = [], [], []
        for _, data, offsets in chunks(batch.column(text_col)):
            data = LOWER[data]
            starts, ends, first = word_bounds(data, offsets)
            window, begin = occurrences(block, data, starts, ends, first)
            text = np.searchsorted(first, begin, side="right") - 1
            words += np.diff(first).tolist()
            own_spans: list[list[list[int]]] = [[] for _ in range(len(offsets) - 1)]
            own_items: list[set[str]] = [set() for _ in range(len(offsets) - 1)]
            for w, b, t in zip(window.tolist(), begin.tolist(), text.tolist()):
                own_spans[t].append([b - int(first[t]), b - int(first[t]) + int(block.length[w])])
                own_items[t].update(block.items[w])
            spans += own_spans
            items += own_items
        if names["spans"] in batch.schema.names:
            spans = [a + (b or []) for a, b in zip(spans, batch.column(names["spans"]).to_pylist())]
            items = [a | set(b or []) for a, b in zip(items, batch.column(names["items"]).to_pylist())]
            batch = batch.drop_columns(list(names.values()))
        columns = {
            names["words"]: pa.array(words, pa.int64()),
            names["spans"]: pa.array([merged(s) for s in spans], pa.list_(pa.list_(pa.int64()))),
            names["items"]: pa.array([sorted(i) for i in items], pa.list_(pa.string())),
        }
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    keep: list[str] | None = None,
    block_windows: int = 200_000,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """Which words of documents stand in an occurrence of a benchmark window.

    Words are runs of 0-9, a-z and characters beyond ASCII, A-Z lowered. A window is ``size``
    consecutive words of an item, all words of an item with fewer; items without words (null or
    empty texts) have none. Items of the same id are one item; a null id counts as an empty one.
    Returns docs (its columns ``keep``, all by default) with n_words, n_hit, items (ids as strings,
    sorted) and contaminated; input columns of these names give way. Documents without words (null,
    empty) have n_words 0 and no hit. Empty tables on either side are fine. Repeated rows are
    answered alike. A text is read whole, however long.

    A prefix-filtered set join. The tokens are shingles of SHINGLE words, ordered by how rarely they
    occur in all documents (a pass that counts the items' tokens). All tokens of a window must
    occur, so its necessary prefix is the rarest one; the join by it, then length and position, then
    the exact words decide. The documents stay where they are: the index of a block of windows,
    bounded by ``block_windows`` and ``block_bytes`` (windows and the ids of their items), goes to all tasks. A larger benchmark is
    joined in several such blocks, one after the other in the same stage, so nothing is left out.
    """
    keep = list(docs.columns) if keep is None else keep
    docs = without(docs, *ADDED)
    keep = [c for c in keep if c in docs.columns]
    spark = docs.sparkSession
    names = fresh(docs, "words", "spans", "items")
    items = benchmark.select(F.col(item_id_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    windows = written(
        items.mapInArrow(lambda batches: spelled_windows(batches, size, "item", "text"), "window string, item string")
        .groupBy("window", F.pmod(F.xxhash64("item"), F.lit(PARTS)).alias("part"))
        .agg(F.collect_set("item").alias("items")),
        "benchmark-windows",
    )
    size_of = F.octet_length("window") + F.aggregate("items", F.lit(0), lambda acc, x: acc + F.octet_length(x) + 8)
    n, n_bytes = windows.agg(F.count("*"), F.coalesce(F.sum(size_of), F.lit(0))).first()
    blocks = max(1, -(-n // block_windows), -(-n_bytes // block_bytes))
    text = docs.select(text_col)
    marked = docs
    schema = T.StructType(docs.schema.fields[:])
    for name, kind in ((names["words"], T.LongType()), (names["spans"], T.ArrayType(T.ArrayType(T.LongType()))), (names["items"], T.ArrayType(T.StringType()))):
        schema = schema.add(name, kind)
    for k in range(blocks):
        own = windows.filter(F.pmod(F.xxhash64("window", "part"), F.lit(blocks)) == k).collect() if blocks > 1 else windows.collect()
        own = sorted((r["window"], r["items"]) for r in own)
        known = spark.sparkContext.broadcast(vocabulary([w for w, _ in own]))
        rarity = (
            text.mapInArrow(lambda batches, known=known: count_tokens(batches, known.value, text_col), "token long, n long")
            .groupBy("token")
            .agg(F.sum("n").alias("n"))
            .collect()
            if own
            else []
        )
        block = spark.sparkContext.broadcast(build(own, {r["token"]: r["n"] for r in rarity}) if own else Block([], [], *[np.zeros(0, np.int64)] * 2, {}, {}, {}, {}))
        marked = marked.mapInArrow(lambda batches, block=block: mark(batches, block.value, text_col, names), schema)
    hit = F.aggregate(names["spans"], F.lit(0).cast("bigint"), lambda acc, s: acc + s[1] - s[0])
    return marked.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(names["words"]).alias("n_words"),
        hit.alias("n_hit"),
        F.col(names["items"]).alias("items"),
        (F.size(names["spans"]) > 0).alias("contaminated"),
    )

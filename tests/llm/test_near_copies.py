"""The near-copy stage of the pipeline against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import near_copies

from .spec import near_labels

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    out: list[str | None] = [None, "", "a b", "A  b", "a b c"]
    shared = [rng.choice(words) for _ in range(30)]
    for k in range(25):
        base = [rng.choice(words) for _ in range(rng.choice((8, 40, 120, 600)))] + (shared if k % 3 == 0 else [])
        out.append(" ".join(base))
        for _ in range(rng.randrange(5)):  # each change touches five shingles: 0.8 is reached or missed
            for _ in range(rng.randrange(1, 2 + len(base) // 40)):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
    dense = [rng.choice(words) for _ in range(150)]
    for k in range(60):
        out.append(" ".join([*dense[: 75 + k % 7], f"v{k}", *dense[75 + k % 7 :]]))
    return out


def test_near_copies_are_the_brute_force_result(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    label = near_labels(texts)
    assert len(set(label)) < len(texts) - 60
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(kept) == sorted(set(label))


def test_rows_without_or_with_repeated_ids_are_cut_to_one(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(None, base), (None, f"{base} x"), (None, "alone without id"), (7, "one two three four five six"), (7, f"{base} y z"), (7, "seven eight nine ten eleven"), (8, f"{base} y")]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, "alone without id"), (7, rows[3][1]), (7, rows[4][1]), (7, rows[5][1])])


def test_groups_of_many_rows_are_compared_in_tiles(spark, monkeypatch):
    """A group without links between its rows' first neighbours: 0.8 is reached by few of its pairs."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(90):
        own = list(base)
        for _ in range(rng.choice((1, 2, 3, 4, 5, 6))):
            own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    label = near_labels(texts)
    assert 2 < len(set(label)) < 89
    for listed, tile in ((32, 512), (4, 16)):
        monkeypatch.setattr(near_copies, "LISTED", listed)
        monkeypatch.setattr(near_copies, "TILE", tile)
        kept = [r.doc_id for r in near_copies.one_of_each(docs).collect()]
        assert sorted(kept) == sorted(set(label))


def test_common_shingles():
    rng = random.Random(4)
    sets = [{rng.randrange(3000) for _ in range(rng.randrange(900))} for _ in range(40)]
    found = near_copies.common_shingles([np.array(sorted(s), np.uint64) for s in sets])
    assert all(found[i, j] == len(sets[i] & sets[j] - {x for x in sets[i] if sum(x in s for s in sets) < 2}) for i in range(40) for j in range(40))


def test_signatures_allow_all_similar_pairs_and_few_others():
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    sets = [draw(int(n)) for n in rng.integers(1, 700, 60)]
    sets += [np.r_[s[: max(1, len(s) * 9 // 10)], draw(len(s) // 10)] for s in sets]  # similar in 0.8 or more
    sets = [np.unique(s) for s in sets]
    known, size = near_copies.Signatures([near_copies.signature(s) for s in sets]), np.array([len(s) for s in sets])
    i, j = np.triu_indices(len(sets), 1)
    similar = np.array([near_copies.similar(set(sets[a].tolist()), set(sets[b].tolist()), (4, 5)) for a, b in zip(i, j)])
    allowed = known.allow(size, i, j, (4, 5)) & near_copies.sizes_allow(size[i], size[j], (4, 5))
    assert similar.sum() > 30 and allowed[similar].all() and allowed.sum() < 2 * similar.sum()


def test_rows_of_a_shingle_that_cannot_be_similar_are_not_listed():
    rng = np.random.default_rng(8)
    sets = [np.unique(np.r_[np.uint64(7), rng.integers(0, 1 << 63, 100, dtype=np.uint64)]) for _ in range(30)]
    batch = near_copies.pa.RecordBatch.from_pydict({"key": [7] * 30, "row": list(range(30)), "size": [len(s) for s in sets], "label": list(range(30)), "signature": [near_copies.signature(s) for s in sets]})
    assert sum(b.num_rows for b in near_copies.other_pairs(iter([batch]), (4, 5))) == 0


def test_fingerprints_within_the_radius_are_pairs(spark):
    known = spark.createDataFrame([(1, 0), (2, 0), (3, 7), (4, 255), (5, 1 << 40)], "row long, print long")
    assert {(r.a, r.b) for r in near_copies.print_pairs(known).collect()} == {(1, 2), (1, 3), (1, 5)}

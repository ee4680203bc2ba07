"""Token counts by public tokenizers, with a cache of counts by content digest."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, join_skewed, text_of, without, written

ADDED = ("n_bytes", "n_tokens")
#: White space to all tokenizers, which others of Unicode's need not be.
SPACES = re.compile("[ \t\n\r]+")
#: Tokenizers whose pre-tokenizer drops white space and never joins what it separates, as tests have found.
BY_PIECE = ("word_bpe_49k.json",)
#: Counts of pieces that a Python worker remembers.
REMEMBERED = 200_000
#: Texts or pieces that are encoded together; an encoding takes about a kilobyte while it lives.
TOGETHER = 2_000
#: Bytes of texts that are worked on together; a longer text is worked on alone.
CHUNK = 1 << 20

_LOADED: dict[str, tuple[Callable[[list[str]], list[int]], dict[str, int]]] = {}


def version(path: str) -> str:
    """The digest of a tokenizer's file, which names its version in the cache."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens, without begin, end or other added tokens, nothing cut or filled up."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encoded(batches: Iterator[pa.RecordBatch], path: str, text: str, by_piece: bool) -> Iterator[pa.RecordBatch]:
    """Counts of whole texts. by_piece: the sum over the pieces between white space, each encoded once while remembered."""
    if path not in _LOADED:
        _LOADED[path] = counter(path), {}
    count, known = _LOADED[path]
    for batch in batches:
        out: list[int] = []
        texts = batch.column(text)
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy() if len(texts) else []
        row = 0
        while row < len(texts):
            begin = ends[row - 1] if row else 0
            end = max(row + 1, int(np.searchsorted(ends, begin + CHUNK, side="right")))
            some = texts.slice(row, end - row).to_pylist()
            row = end
            if not by_piece:
                for k in range(0, len(some), TOGETHER):
                    out += count(some[k : k + TOGETHER])
                continue
            for t in some:
                pieces = [p for p in SPACES.split(t) if p]
                new = [p for p in dict.fromkeys(pieces) if p not in known]
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = list(dict.fromkeys(pieces))
                for k in range(0, len(new), TOGETHER):
                    known.update(zip(new[k : k + TOGETHER], count(new[k : k + TOGETHER])))
                out.append(sum(map(known.__getitem__, pieces)))
        rest = [c for c in batch.schema.names if c != text]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out, pa.int64())], [*rest, "n_tokens"])


CACHED = "digest binary, n_tokens long"


def one_space(text: Column) -> Column:
    """Text with the same count for tokenizers in BY_PIECE: runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "[ \t\n\r]+", " "))


def cached_counts(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) that the cache has for a tokenizer version.

    An empty part is appended first, so that there is something to read.
    """
    path = f"{cache}/tokenizer={tokenizer}"
    spark.createDataFrame([], CACHED).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(CACHED).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache: str,
    text_col: str = "text",
    by_piece: bool = False,
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The number of tokens of each whole text.

    Returns the rows of docs with n_bytes (UTF-8) and n_tokens; input columns of these names give
    way. Null is the empty text. Repeated texts get the same counts; an empty table gives no rows.
    A text of any length is encoded whole, a very long one alone or, ``by_piece``, in pieces.

    The cache is a Parquet folder of (digest, n_tokens), one part per tokenizer version, the digest of
    its file. Normalised contents are joined to it by digest; of those that it lacks each is encoded
    once and appended. Appending twice (a job run twice) does no harm: equal contents have equal
    counts. ``normalise`` maps texts that certainly have the same count to one content; the default is
    the text as it is. ``by_piece`` is for the tokenizers in BY_PIECE, others are refused: counts of
    pieces between white space are remembered within a Python worker, and one_space is the default
    of ``normalise``.

    Copies are combined before any shuffle, so a content that a third of all rows share is one row a
    map task when it meets the cache; its count goes back to its rows by broadcast (join_skewed).
    """
    if by_piece and os.path.basename(tokenizer_path) not in BY_PIECE:
        raise ValueError(f"{os.path.basename(tokenizer_path)} isn't known to count texts by their pieces")
    docs = without(docs, *ADDED)
    spark = docs.sparkSession
    digest = fresh(docs, "digest")["digest"]
    normalise = normalise or (one_space if by_piece else lambda text: text)
    content = normalise(text_of(text_col))
    key = F.unhex(F.sha2(content, 256))
    tokenizer = version(tokenizer_path)
    # Copies are combined in the map tasks, before texts are shuffled; what is left is one row a digest.
    contents = docs.select(key.alias("digest"), content.alias("text")).dropDuplicates(["digest"])
    missing = contents.join(cached_counts(spark, cache, tokenizer), "digest", "left_anti")
    missing.mapInArrow(lambda batches: encoded(batches, tokenizer_path, "text", by_piece), CACHED).write.mode("append").parquet(f"{cache}/tokenizer={tokenizer}")
    found = docs.select(key.alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    known = written(found.join(cached_counts(spark, cache, tokenizer), "digest").withColumnRenamed("digest", digest), "token-counts")
    rows = docs.withColumn(digest, key).withColumn("n_bytes", F.octet_length(text_of(text_col)).cast("bigint"))
    return join_skewed(rows, known, digest, "n").drop(digest)

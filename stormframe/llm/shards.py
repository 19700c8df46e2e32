"""Token shards in training order.

Texts become token ids of a public tokenizer, packed into sequences of a fixed length.  A keyed
Feistel permutation with cycle-walking maps a sequence's ordinal to its global slot; a range of
slots is a shard, a file of records of one fixed size, so that training reads files from end to end
and resumes at any slot by arithmetic.
"""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormframe.llm.common import scratch, text_batches, written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Id that ends a document and fills the last sequence of a partition; it is free in the vocabulary.
END = 50_256
LENGTH = 4_096
SHARD_SEQUENCES = 2_048
KEY = 0x5EED_0F_0DE5
ROUNDS = 6
#: Records of text files end with this byte, so a record takes 2 * LENGTH + 1 bytes.
TERMINATOR = "\n"
_MASK = (1 << 64) - 1


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary of that name lies."""
    return importlib.import_module("public_tokenizers").path(name)


def encoder(path: str):
    """The tokenizer of a vocabulary file of ranks; it treats every string as ordinary text."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=importlib.import_module("public_tokenizers").PATTERN, mergeable_ranks=ranks, special_tokens={})


def permuted(ordinals: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """Slots of ordinals in [0, size): a balanced Feistel network over the next even number of bits; values outside walk on."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64(((key + 1) * 0x9E3779B97F4A7C15 * (r + 1) ^ (key >> r)) & _MASK) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            f = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & low)
        return (left << np.uint64(half)) | right

    out = once(ordinals.astype(np.uint64))
    while (outside := out >= size).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def sequences(documents: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """``(part, at, n_tokens, doc_ids, lengths, tokens)``: each input partition's documents as sequences.

    Every document, an empty or null text included, ends with one END.  ``doc_ids`` and ``lengths``
    say whose tokens a sequence holds, in order; ``tokens`` are little-endian 16-bit ids, compressed
    one sequence at a time.  Only the last sequence of a partition is filled up.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, squeeze, part, at = encoder(path), zstandard.ZstdCompressor(6), TaskContext.get().partitionId(), 0
        held, owners, lengths, size = [], [], [], 0
        rows: list[tuple] = []

        def close() -> None:
            nonlocal held, owners, lengths, size, at
            record = np.full(length, END, "<u2")
            record[:size] = np.concatenate(held)
            rows.append((part, at, size, owners, lengths, squeeze.compress(record.tobytes())))
            held, owners, lengths, size, at = [], [], [], 0, at + 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
            return out

        names = ["part", "at", "n_tokens", "doc_ids", "lengths", "tokens"]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        for batch in (x for whole in batches for x in text_batches(whole, "text")):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*tokens.encode_ordinary(text or ""), END], "<u2")
                while len(ids):
                    piece, ids = ids[: length - size], ids[length - size :]
                    held.append(piece)
                    owners.append(doc_id)
                    lengths.append(len(piece))
                    size += len(piece)
                    if size == length:
                        close()
            if rows:
                yield flush()
        if size:
            close()
            yield flush()

    schema = "part int, at long, n_tokens int, doc_ids array<long>, lengths array<int>, tokens binary"
    return documents.select("doc_id", "text").mapInArrow(pack, schema)


def materialise(
    documents: DataFrame, path: str | None = None, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, key: int = KEY, out: str | None = None
) -> tuple[DataFrame, str]:
    """Write the shards; give the index ``(slot, shard, byte_offset, n_tokens, doc_ids, lengths)`` and their folder.

    Ordinals run through the input partitions in order, so the same table read with the same split
    settings gives the same files.  Only one number per partition comes to the driver.  An empty
    table gives an empty index and no shard.
    """
    spark = documents.sparkSession
    out = out or scratch(spark, "shards")
    made = written(sequences(documents, path or vocabulary_path(), length), "sequences")
    counts = made.groupBy("part").agg((F.max("at") + 1).alias("n")).orderBy("part").toArrow()
    starts = np.concatenate([[0], np.cumsum(counts["n"].to_numpy())]).astype(np.int64)
    offset = dict(zip(counts["part"].to_pylist(), starts.tolist(), strict=False))
    size = int(starts[-1])

    @F.pandas_udf(T.LongType())
    def slot(part, at):
        import pandas as pd

        return pd.Series(permuted(part.map(offset).to_numpy(np.int64) + at.to_numpy(np.int64), size, key))

    placed = made.withColumn("slot", slot("part", "at"))
    shards = max(1, -(-size // shard_sequences))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor()
        for batch in batches:
            raw = pa.array([loose.decompress(t) for t in batch.column("tokens").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("shard"), raw], ["shard", "value"])

    shard = F.floor(F.col("slot") / shard_sequences).cast("int")
    ranges = placed.select(shard.alias("shard"), "slot", "tokens").repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    records = ranges.select("shard", "tokens").mapInArrow(unpack, "shard int, value binary")
    # A text file's line is the record's bytes as they are.
    records.select("shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", TERMINATOR).text(out)
    index = placed.select(
        "slot", shard.alias("shard"), ((F.col("slot") % shard_sequences) * (2 * length + 1)).alias("byte_offset"), "n_tokens", "doc_ids", "lengths"
    )
    return index, out

"""What several operators share: scratch tables, word hashes and sums of vectors."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- scratch tables


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares, removed when the session's JVM ends.

    The folder is the one named in ``spark.checkpoint.dir``; where that is unset (tests), one
    inside the warehouse is used and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: its lineage ends there.

    What only earlier tables were made from is garbage then; the driver collects it at once, for
    Spark removes shuffle files only when their plans are collected.
    """
    path = scratch(df.sparkSession, name)
    df.sparkSession._jvm.System.gc()
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing will read it again."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


# ---------------------------------------------------------------- words of whole texts

#: Words are maximal runs of bytes other than these; A-Z are folded to a-z.
SEPARATORS = b" \t\n\v\f\r"
#: Bytes of text that one numpy pass works on; longer texts are cut between words.
PASS_BYTES = 2_000_000

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[list(SEPARATORS)] = True
_BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of byte strings, many at a time.

    A word's polynomial hash is a difference of prefix sums, made independent of its place by the
    inverse power of its start.
    """

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def _of(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the words of ``data``; a word also ends before each of ``breaks``."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        letter = ~_SPACE[data]
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        last = letter.copy()
        last[:-1] &= ~letter[1:]
        inner = breaks[(breaks > 0) & (breaks < n)]
        first[inner] = letter[inner]
        last[inner - 1] = letter[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last)
        sums = np.cumsum(_BYTE[data] * self.up[:n])
        h = sums[ends] - np.where(starts > 0, sums[starts - 1], np.uint64(0))
        return mix(h * self.down[starts] + (ends - starts).astype(np.uint64)), starts

    def words(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Yield ``(row, end row, hashes, counts)``: the words of rows [row, end), and how many each row has."""
        texts = as_binary(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(texts):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PASS_BYTES, "right")) - 1)
            lo, hi = int(offsets[row]), int(offsets[end])
            if end > row + 1 or hi - lo <= PASS_BYTES:
                hashes, starts = self._of(data[lo:hi], offsets[row : end + 1] - lo)
                counts = np.diff(np.searchsorted(starts, offsets[row : end + 1] - lo))
            else:
                parts = []
                while lo < hi:
                    cut = lo + PASS_BYTES
                    while cut < hi and not _SPACE[data[cut]]:
                        cut += 1
                    parts.append(self._of(data[lo : min(cut, hi)], np.zeros(0, np.int64))[0])
                    lo = cut
                hashes = np.concatenate(parts)
                counts = np.array([len(hashes)])
            yield row, end, hashes, counts
            row = end


def as_binary(texts: pa.Array) -> pa.Array:
    """A text column as large binary; null reads as empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    return pc.fill_null(texts, "").view(pa.large_binary())


def text_batches(batch: pa.RecordBatch, column: str, most: int = 8 * PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each (a longer text is alone)."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
    total, start = 0.0, 0
    for i, size in enumerate(sizes):
        if total + size > most and i > start:
            yield batch.slice(start, i - start)
            total, start = 0.0, i
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def held_out(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id's decimal text leaves ``remainder``.  A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


# ---------------------------------------------------------------- fixed-size vectors summed over tasks

VECTOR = "chunk int, part int, counts binary"
_CHUNKS = 64


def vector_rows(total: np.ndarray) -> pa.RecordBatch:
    """A task's vector of counts as compressed rows of 1/64 of its length."""
    part = TaskContext.get().partitionId()
    rows = [zlib.compress(c.astype(np.int64).tobytes(), 1) for c in np.array_split(total, _CHUNKS)]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(_CHUNKS), pa.int32()), pa.array([part % 16] * _CHUNKS, pa.int32()), pa.array(rows, pa.binary())], ["chunk", "part", "counts"]
    )


def summed(vectors: DataFrame, finish: Callable[[np.ndarray], np.ndarray] = lambda counts: counts) -> np.ndarray:
    """The sum of all tasks' vectors, added up chunk by chunk in two steps; only the sum, after ``finish``, comes together on the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = np.int64(0)
        for c in table["counts"].to_pylist():
            total = total + np.frombuffer(zlib.decompress(c), np.int64)
        return pa.table({"chunk": table["chunk"][:1], "part": table["part"][:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    sums = vectors.groupBy("chunk", "part").applyInArrow(add, VECTOR).groupBy("chunk").applyInArrow(add, VECTOR).toArrow()
    order = np.argsort(sums["chunk"].to_numpy())
    chunks = [finish(np.frombuffer(zlib.decompress(sums["counts"][int(i)].as_py()), np.int64)) for i in order]
    return np.concatenate(chunks) if chunks else finish(np.zeros(0, np.int64))

"""Arrow and numpy helpers that the training-data operators share.

All of them work on whole texts and on slices of a batch whose size is bounded in bytes,
so that a Python worker's memory doesn't follow the batch that Spark happens to send.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
BATCH_BYTES = 8 << 20
CHUNK = 1 << 18
#: Bytes of a row group of tables between steps: what a writer holds in memory.
ROW_GROUP = 16 << 20
U = np.uint64

_rng = np.random.default_rng(20240607)
_COEFFICIENTS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place on a fresh array."""
    x = x ^ (x >> U(31))
    x *= U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of `column`; one longer value is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right"))
        hi = max(hi, lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD6E8FEB86659FD93))


def powers(base: int, n: int) -> np.ndarray:
    """Powers 0..n-1 of a number modulo 2^64."""
    out = np.full(n, base % 2**64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_UP, _DOWN = powers(_BASE, CHUNK + 1), powers(pow(_BASE, -1, 2**64), CHUNK + 1)


def hashed_words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of `data`, from prefix sums: a word's hash depends on its bytes alone."""
    inside = np.concatenate(([False], ~SPACE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = len(data) > CHUNK
    up, down = (powers(_BASE, len(data) + 1), powers(pow(_BASE, -1, 2**64), len(data) + 1)) if long else (_UP, _DOWN)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, and the number of words of each."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    before = np.concatenate(([0], np.cumsum(first)))
    counts = np.diff(before[np.concatenate(([0], ends))])
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(data):
        # chunks end after a blank, so that no word is cut; a longer word makes a longer chunk
        stop = min(at + CHUNK, len(data))
        blanks = np.flatnonzero(space[at:stop])
        if len(blanks):
            stop = at + int(blanks[-1]) + 1
        else:
            while not space[stop - 1]:
                more = np.flatnonzero(space[stop : stop + CHUNK])
                stop = stop + int(more[0]) + 1 if len(more) else stop + CHUNK
        out.append(hashed_words(data[at:stop]))
        at = stop
    return np.concatenate(out), counts


_libc = ctypes.CDLL(None)


def release() -> None:
    """Gives free memory back to the system, so that reused workers don't add up over stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that leaves no free memory behind in its worker."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def window_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` words inside each text, and how many each text has."""
    n = len(words)
    have = np.maximum(counts - width + 1, 0)
    if n < width:
        return np.empty(0, np.uint64), have
    h = words[: n - width + 1] * _COEFFICIENTS[0]
    for k in range(1, width):
        h += words[k : n - width + 1 + k] * _COEFFICIENTS[k]
    return mix(h)[window_starts(counts, width)], have


def window_starts(counts: np.ndarray, width: int) -> np.ndarray:
    """Positions of words at which a window of `width` words begins."""
    have, first = np.maximum(counts - width + 1, 0), np.cumsum(counts) - counts
    before = np.cumsum(have) - have
    return np.arange(int(have.sum())) + np.repeat(first - before, have)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words than `width`, the whole sequence is one."""
    words, counts = word_hashes(texts)
    hashes, have = window_hashes(words, counts, width)
    ends, first = np.cumsum(have), np.cumsum(counts) - counts
    out = []
    for i, c in enumerate(counts):
        if have[i]:
            out.append(np.unique(hashes[ends[i] - have[i] : ends[i]]))
        elif c:
            w = words[first[i] : first[i] + c]
            out.append(mix((w * _COEFFICIENTS[8 : 8 + c]).sum(keepdims=True) + _COEFFICIENTS[20 + c]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def parts(keys: np.ndarray, n: int) -> np.ndarray:
    """A part from 0 to n-1 for each key, by ranges of the key."""
    return ((keys >> U(32)) * U(n) >> U(32)).astype(np.int32)


def packed(part: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """One tuple (part, bytes of each array) for each part that occurs."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.flatnonzero(np.diff(part)) + 1
    lo = np.concatenate(([0], cut))
    hi = np.concatenate((cut, [len(part)]))
    arrays = [a[order] for a in arrays]
    for a, b in zip(lo.tolist(), hi.tolist()):
        yield (int(part[a]), *(x[a:b].tobytes() for x in arrays))


def unpacked(column: pa.Array | pa.ChunkedArray, dtype) -> np.ndarray:
    """The arrays of a binary column, one after another."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def n_parts(spark: SparkSession) -> int:
    """Parts of a packed shuffle: a few for each shuffle partition."""
    return max(32, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where none is set and all runs on one machine, one of our own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file:///tmp/checkpoints/dossia"  # one machine, as in tests
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # what a Python worker is sent at a time
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder, with a short lineage."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a side that is broadcast, at most.
BROADCAST_ROWS = 100_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows marked for a broadcast if they are few, which a count up to the bound tells; else as they are, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder."""
    at = f"{shared(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components (node, root: the smallest node reachable) of distributed edges.

    Alternates large-star and small-star steps until nothing moves; each step groups edges
    by a node and keeps only a running minimum, and every round is checkpointed.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e)
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour of a node points at the node's minimum
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: a node and its smaller neighbours point at the smallest of them
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if now == before:
            return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        before = now

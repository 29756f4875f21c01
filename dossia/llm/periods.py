"""Periodic run detection over words: Lyndon roots by a stack, extended by rolling-hash comparisons (operator 12).

A run is a stretch of words with a smallest period q and a length of at least max(6, 4 q) that neither neighbour extends.
By the runs theorem each run has a root, a word of its period, that is the longest Lyndon word at its place in one of two
opposite orders of the alphabet. A stack scanned from right to left gives the longest Lyndon word at every place: the next
suffix that is smaller. Two suffixes are compared by their first words; where these agree, by their longest common extension,
found by doubling and binary search over rolling hashes. The same extension, to the right and mirrored to the left, grows
a root into its run.

Hashes decide no equality: what they call equal is compared word by word, and stretches known to be equal at a distance are
kept, so that a long repetition is verified once and not again from each of its places. Words are numbered by their bytes, not
by a hash. No suffix array is built; each text is worked on by itself, in time n log n, and nothing is shuffled.

A run of four periods holds each pair of its neighbours three times at least. So no run passes a place where a pair stands that
its text has fewer than three times, and the stretches between such places are searched one by one; of prose little is left.

Null text and text without words have no runs; repeated rows are searched each; runs that tie in length are ordered by start,
then period; an empty table gives no rows; a text of any length is searched whole, in one task (a word takes some 150 bytes there);
other columns are ignored, and columns of docs named in `keep` are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossia.llm.kernels import U, as_bytes, mix, shared, slices, tidy, window_hashes, word_hashes

LEAST, TIMES = 6, 4
BLANK = r"[\x20\x09-\x0D]+"
_BASE = 0x9E3779B97F4A7C15 | 1


class Extension:
    """Longest common extensions of the places of one text, to the right."""

    def __init__(self, words: np.ndarray):
        self.words, self.n = words, len(words)
        power = np.full(self.n + 1, _BASE % 2**64, np.uint64)
        power[0] = 1
        self.power = np.multiply.accumulate(power, dtype=np.uint64)
        #: sums[k] has the words before k, each times the power of its place
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix(words.astype(np.uint64) + U(1)) * self.power[: self.n], out=self.sums[1:])
        self.raw = memoryview(np.ascontiguousarray(words))
        #: by distance: the stretch of places known to equal those so far on, and that ends there for good
        self.known: dict[int, tuple[int, int]] = {}

    def same_hash(self, i, j, length):
        """Whether the hashes of two stretches agree; i, j and length may be arrays, i <= j."""
        with np.errstate(over="ignore"):
            return (self.sums[i + length] - self.sums[i]) * self.power[j - i] == self.sums[j + length] - self.sums[j]

    def verified(self, i: int, j: int, length: int) -> int:
        """How many of so many words at i and j are the same, word by word."""
        if self.raw[i : i + length] == self.raw[j : j + length]:
            return length
        return int(np.argmax(self.words[i : i + length] != self.words[j : j + length]))

    def __call__(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on, i < j."""
        far = j - i
        start, end = self.known.get(far, (0, 0))
        if start <= i < end:
            return end - i
        most = self.n - j
        # a stretch known further right: as soon as it is reached, its end is this one's
        reach = start - i if i < start < end else most
        low, step = 0, 4
        while low < reach and step and self.same_hash(i + low, j + low, size := min(step, reach - low)):
            low += size
            step *= 2
        if low < reach:
            high = min(low + step, reach)  # differs before here
            while high - low > 1:
                mid = (low + high) // 2
                if self.same_hash(i + low, j + low, mid - low):
                    low = mid
                else:
                    high = mid
        same = self.verified(i, j, low)
        if same == reach < most:
            same = end - i
        if same > 8:
            self.known[far] = (i, i + same)
        return same


def lyndon_ends(words: list[int], extension: Extension) -> list[int]:
    """For each place where the next smaller suffix begins, the end being smaller than all; `words` are in the order asked for."""
    n = len(words)
    ends, stack = [n] * n, []
    push, pop = stack.append, stack.pop
    for i in range(n - 1, -1, -1):
        w = words[i]
        while stack:
            j = stack[-1]
            v = words[j]
            if v < w:
                break
            if v == w:
                same = extension(i, j)
                if j + same == n or words[j + same] < words[i + same]:
                    break
            pop()
        if stack:
            ends[i] = stack[-1]
        push(i)
    return ends


def runs_of(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers, by start and period; `times` is 3 or more."""
    n = len(words)
    if n < max(least, times):
        return []
    array = np.array(words, np.int64)
    right = Extension(array)
    left = Extension(array[::-1])
    found: dict[int, list[tuple[int, int]]] = {}
    for order in (words, [-w for w in words]):
        ends = np.array(lyndon_ends(order, right), np.int64)
        at = np.arange(n)
        period = ends - at
        # a run of so many periods repeats its leftmost root times - 2 times more at least
        reach = period * (times - 2)
        ok = np.flatnonzero(ends + reach <= n)
        ok = ok[right.same_hash(at[ok], ends[ok], reach[ok])]
        for i, p in zip(ok.tolist(), period[ok].tolist()):
            runs = found.setdefault(p, [])
            if any(a <= i and i + p <= b for a, b in runs[-1:]):  # another root of the same run
                continue
            end = i + p + right(i, i + p)
            start = i - (left(n - (i + p), n - i) if i else 0)
            if end - start >= max(least, times * p):
                runs.append((start, end))
    return sorted({(a, b - a, p) for p, runs in found.items() for a, b in runs}, key=lambda r: (r[0], r[2]))


def stretches(texts: list[bytes], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int]]]:
    """For each text the stretches of words, from and to, outside of which no run lies.

    Pairs are counted by hashes: two that share one count as more, which leaves more to search.
    """
    words, counts = word_hashes(texts)
    pairs, have = window_hashes(words, counts, 2)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(pairs):
        return out
    owner = np.repeat(np.arange(len(texts)), have)
    key = mix(pairs + mix(owner.astype(np.uint64) + U(1)))
    order = np.argsort(key)
    edge = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1], [True])))
    often = np.zeros(len(key), bool)
    often[order] = np.repeat(np.diff(edge) >= times - 1, np.diff(edge))
    # stretches of such pairs within a text
    apart = np.concatenate(([True], owner[1:] != owner[:-1]))
    starts = np.flatnonzero(often & (apart | ~np.concatenate(([False], often[:-1]))))
    ends = np.flatnonzero(often & np.concatenate((apart[1:] | ~often[1:], [True]))) + 1
    first = np.cumsum(have) - have
    for a, b in zip(starts.tolist(), ends.tolist()):
        if b - a + 1 >= max(least, times):
            t = int(owner[a])
            out[t].append((a - int(first[t]), b - int(first[t]) + 1))
    return out


def numbered(words: list[bytes]) -> list[int]:
    """Each word's number, by first appearance."""
    of: dict[bytes, int] = {}
    return [of.setdefault(w, len(of)) for w in words]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    kept = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        kept[start + period] += 1
        kept[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(kept[:-1]) == 0).tolist()])


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, keep: list[str] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The columns of `keep`, `runs` (an array of start, length and period in words, by start and period) and `collapsed`, the text without repetitions."""
    shared(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                runs, texts = [], []
                whole = as_bytes(part.column("text"))
                for text, where in zip(whole, stretches(whole, least, times)):
                    words = text.split()
                    found = [(a + s, n, p) for a, b in where for s, n, p in runs_of(numbered(words[a:b]), least, times)]
                    runs.append([{"start": a, "length": n, "period": p} for a, n, p in found])
                    texts.append(collapsed(words, found).decode())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(runs, RUNS), pa.array(texts, pa.string())], ["row", "runs", "collapsed"])

    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(tidy(run), f"row {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.select("row.*", "runs", "collapsed")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """`doc_id, text`: of one document in ten, by the check sum of its id, the words from some place on repeat with a period."""
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), BLANK), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    rows = rows.withColumn("ws", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("ws").cast("long"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("n", n).withColumn("g", g).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a = F.col("a")
    planted = F.concat_ws(" ", F.transform("ws", lambda w, i: F.when(i >= a, F.get(F.col("ws"), (a + (i - a) % F.col("p")).cast("int"))).otherwise(w)))
    return rows.select("doc_id", F.when(a.isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """`doc_id, n_runs`, the longest run with its exponent in thousandths, and SHA-256 of all runs and of the collapsed text."""
    # ties of length go to the smallest start, then period, which is the order of runs
    top = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    rows = found.withColumn("top", top)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )

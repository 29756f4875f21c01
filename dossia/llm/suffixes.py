"""Suffix-array deduplication by external induced sorting (operator 3).

Bytes covered by a string of `width` bytes that starts anywhere else too are found exactly, over
all documents:

1. Sharding. The smallest hash of a shorter gram in a window of `width` bytes depends on the window's
   content alone, so equal windows have equal keys. A first scan counts the gram positions that are
   some window's minimum (about one byte in a hundred); keys met twice become a bitmap of bounded size.
2. A second scan sends runs of windows whose key was met twice to the key's shard, equal runs once
   a slice with a list of their holders.
3. Each shard builds the suffix order of its distinct runs by induced sorting: suffix tuples go through
   first-in-first-out queues, one per character, which together are a priority queue by (character,
   rank of the inducing suffix) and move to disk when they outgrow their memory. Neighbours in the
   order whose common prefix reaches `width` are repeated strings.
4. Repeated ranges are gathered and merged per document text, and cut out.

`digest` also tells passages, that is maximal ranges of repeated strings of PASSAGE_BYTES bytes that have PASSAGE_WORDS words
or more: steps 2 to 4 run once more at that width. The grams of both widths are the same, so a wider window's minimum
is some narrower window's too, and one first scan serves both. Passages are counted, not cut out.

The order of the recursion's reduced string has an alphabet as large as itself; where that exceeds
SMALL_ALPHABET characters it is sorted by rank doubling (to a depth of `width` bytes, all that is needed)
instead of by queues. Common prefixes are compared by 64-bit hashes of `width` bytes between neighbours
rather than carried as lengths.

Equal texts are one text that occurs more than once: from `width` bytes on, all of it goes. Null texts
are empty, texts shorter than `width` keep everything, repeated rows count as further places, an
empty table gives no rows, a text of any length is read whole, its windows dealt to shards as others' are,
and other columns are kept by `deduplicated` and ignored by `digest`.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossia.llm.kernels import U, as_bytes, cut, mix, n_parts, packed, parts, slices, tidy, unpacked

WIDTH = 400
#: A passage is repeated if so many bytes of it are the same elsewhere, and so many words: 50 words have some 250 bytes or more in prose.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 50
#: Bytes of a gram where windows of WIDTH and PASSAGE_BYTES bytes share them.
GRAM = 64
STEP = 1 << 19
MAX_BITS = 1 << 28
SHARD_BYTES = 1 << 19
QUEUE_BYTES = 64 << 20
SMALL_ALPHABET = 1024

_P = 0x9E3779B97F4A7C15 | 1
_R = mix(np.arange(1, 258, dtype=np.uint64) * U(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def power(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..n-1 of an odd number modulo 2^64, or of its inverse."""
    name = "inverse" if inverse else "plain"
    have = _powers.get(name)
    if have is None or len(have) < n:
        base = pow(_P, -1, 2**64) if inverse else _P
        have = np.full(max(n, 2 * STEP), base, np.uint64)
        have[0] = 1
        have = _powers[name] = np.multiply.accumulate(have, dtype=np.uint64)
    return have[:n]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences, times an inverse power, are hashes of any substring."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_R[codes] * power(len(codes)), out=out[1:])
    return out


def hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all substrings of `width` characters."""
    n = len(sums) - width
    return mix((sums[width:] - sums[:n]) * power(n, True)) if n > 0 else np.zeros(0, np.uint64)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every `width` neighbours."""
    got, have = values, 1
    while 2 * have <= width:
        got, have = pick(got[:-have], got[have:]), 2 * have
    return pick(got[: len(got) - (width - have)], got[width - have :]) if have < width else got


class Scan:
    """Windows of distinct texts: keys of windows, by runs of equal keys, and the positions that are minima."""

    def __init__(self, texts: list[bytes], width: int, gram: int):
        span = width - gram + 1
        pieces = [(i, a, t[a : a + STEP + width - 1]) for i, t in enumerate(texts) for a in range(0, len(t) - width + 1, STEP)]
        self.data = b"".join(p for _, _, p in pieces)
        length = np.array([len(p) for _, _, p in pieces], np.int64)
        ends = np.cumsum(length)
        codes = np.frombuffer(self.data, np.uint8)
        grams = hashes(prefix_sums(codes), gram)
        lows = sliding(grams, span, np.minimum)
        windows = length - width + 1
        # the place in `data` of each valid window, piece by piece
        self.at = np.arange(int(windows.sum())) + np.repeat(ends - length - (np.cumsum(windows) - windows), windows)
        keys = lows[self.at]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (np.diff(self.at) != 1)
        first = np.flatnonzero(new)
        self.keys, self.starts = mix(keys[first] + U(1)), self.at[first]  # minima crowd at 0, so they are mixed again
        self.stops = self.at[np.append(first[1:], len(keys)) - 1] + width if len(first) else first
        piece = np.searchsorted(ends, self.starts, "right")
        self.text = np.array([i for i, _, _ in pieces], np.int64)[piece] if len(first) else first
        base = ends - length - np.array([a for _, a, _ in pieces], np.int64) if pieces else ends
        self.place = self.starts - base[piece] if len(first) else first
        # a gram is some window's minimum if it is the largest minimum of the windows around it
        valid = np.zeros(len(grams), np.uint64)
        valid[self.at] = keys
        around = sliding(np.concatenate((np.zeros(span - 1, np.uint64), valid)), span, np.maximum) if len(grams) else valid
        self.minima = mix(grams[around == grams] + U(1))


def distinct(texts: list[bytes], width: int) -> tuple[list[bytes], list[bytes]]:
    """Distinct texts of at least `width` bytes and their MD5 digests."""
    own = list(dict.fromkeys(t for t in texts if len(t) >= width))
    return own, [hashlib.md5(t).digest() for t in own]


def repeated_keys(docs: DataFrame, width: int, gram: int, n: int) -> DataFrame:
    """(part, keys, many): window keys whose gram is a minimum at two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=STEP):
                texts, _ = distinct(as_bytes(part.column("text")), width)
                if texts:
                    keys, counts = np.unique(Scan(texts, width, gram).minima, return_counts=True)
                    keys = np.repeat(keys, np.minimum(counts, 2))
                    rows = list(packed(parts(keys, n), keys))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary()))], names=["part", "keys"])

    def twice(table: pa.Table) -> pa.Table:
        keys, counts = np.unique(unpacked(table.column("keys"), np.uint64), return_counts=True)
        keys = keys[counts > 1]
        return pa.table({"part": table.column("part")[:1].cast(pa.int32()), "keys": pa.array([keys.tobytes()], pa.binary()), "many": pa.array([len(keys)], pa.int64())})

    return cut(docs.mapInArrow(tidy(run), "part int, keys binary").groupBy("part").applyInArrow(twice, "part int, keys binary, many long"))


def bitmap(found: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the keys' leading bits, of 16 bits a key and MAX_BITS at most. n: a power of two."""
    many = found.agg(F.sum("many")).first()[0] or 0
    bits = min(MAX_BITS, max(n * 8, 1 << (16 * many).bit_length()))
    shift = U(64 - (bits.bit_length() - 1))
    size = bits // n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                on = np.zeros(size, np.uint8)
                on[(np.frombuffer(keys, np.uint64) >> shift).astype(np.int64) - part * size] = 1
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(on).tobytes()], pa.binary())], names=["part", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    for part, own in found.select("part", "keys").mapInArrow(tidy(run), "part int, bits binary").toLocalIterator():
        out[part * size // 8 : (part + 1) * size // 8] = np.frombuffer(bytes(own), np.uint8)
    return out


def runs(docs: DataFrame, sent, width: int, gram: int, n: int) -> DataFrame:
    """(part, runs...): runs of windows with a repeated key, distinct in their slice, with their holders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = sent.value
        shift = U(64 - ((len(on) * 8).bit_length() - 1))
        for batch in batches:
            for part in slices(batch, limit=STEP):
                texts, digests = distinct(as_bytes(part.column("text")), width)
                if not texts:
                    continue
                scan = Scan(texts, width, gram)
                bit = (scan.keys >> shift).astype(np.int64)
                hit = np.flatnonzero(on[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
                held: dict[tuple[int, bytes], list[tuple[bytes, int]]] = {}
                for key, a, b, i, place in zip(scan.keys[hit].tolist(), scan.starts[hit].tolist(), scan.stops[hit].tolist(), scan.text[hit].tolist(), scan.place[hit].tolist()):
                    held.setdefault((key, scan.data[a:b]), []).append((digests[i], place))
                by_part: dict[int, list] = {}
                for (key, data), holders in held.items():
                    by_part.setdefault((key >> 32) * n >> 32, []).append((key, data, holders))
                out = [
                    (
                        p, np.array([k for k, _, _ in rows], np.uint64).tobytes(), np.array([len(d) for _, d, _ in rows], np.uint32).tobytes(), b"".join(d for _, d, _ in rows), np.array([len(h) for _, _, h in rows], np.uint32).tobytes(),
                        b"".join(d for _, _, h in rows for d, _ in h), np.array([x for _, _, h in rows for _, x in h], np.int64).tobytes(),
                    )
                    for p, rows in by_part.items()
                ]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32()] + [pa.binary()] * 6)], names=["part", "keys", "lengths", "data", "n_holders", "digests", "places"])

    return docs.mapInArrow(tidy(run), "part int, keys binary, lengths binary, data binary, n_holders binary, digests binary, places binary")


class Queue:
    """A first-in-first-out queue of positions that moves to a file of its own when it outgrows its share."""

    def __init__(self, limit: int, folder: str):
        self.chunks: list[np.ndarray] = []
        self.limit, self.folder, self.size, self.file = limit, folder, 0, None

    def push(self, x: np.ndarray) -> None:
        if not len(x):
            return
        self.chunks.append(x)
        self.size += x.nbytes
        if self.size > self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=self.folder)
            for c in self.chunks:
                c.tofile(self.file)
            self.chunks, self.size = [], 0

    def pop(self) -> np.ndarray:
        """All that is in the queue, in order; it is empty afterwards."""
        chunks = self.chunks
        if self.file is not None:
            self.file.seek(0)
            chunks = [np.fromfile(self.file, np.int32), *chunks]
            self.file.close()
            self.file = None
        self.chunks, self.size = [], 0
        return np.concatenate(chunks) if chunks else np.zeros(0, np.int32)


def induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, sigma: int, folder: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """L and S suffixes by first character, in order, induced from the seeds (leftmost S suffixes, sorted)."""
    queues = [Queue(QUEUE_BYTES // sigma, folder) for _ in range(sigma)]
    by_char = np.argsort(text[seeds], kind="stable")
    seeds = seeds[by_char]
    cuts = np.searchsorted(text[seeds], np.arange(sigma + 1))

    def spread(items: np.ndarray, wanted: bool, own: int) -> np.ndarray:
        """Pushes the predecessors of the wanted type, in order; returns those that start with `own`."""
        before = items[items > 0] - 1
        before = before[is_s[before] == wanted]
        if not len(before):
            return before
        chars = text[before]
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        edges = np.flatnonzero(np.diff(chars)) + 1
        same = before[:0]
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(before)]):
            if (c := int(chars[a])) == own:
                same = before[a:b]
            else:
                queues[c].push(before[a:b])
        return same

    def drained(c: int, wanted: bool) -> np.ndarray:
        out, items = [], queues[c].pop()
        while len(items):
            out.append(items)
            items = spread(items, wanted, c)
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    large = []
    for c in range(sigma):
        large.append(drained(c, False))
        if cuts[c] < cuts[c + 1]:
            spread(seeds[cuts[c] : cuts[c + 1]], False, -1)
    small: list[np.ndarray] = [large[0][:0]] * sigma
    for c in range(sigma - 1, -1, -1):
        small[c] = drained(c, True)[::-1]
        if len(large[c]):
            spread(large[c][::-1], True, -1)
    return large, small


def doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of `names` in order of their first `depth` names at least, by rank doubling of unresolved ones."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    # a rank is the first place of its class
    sorted_ = names[order]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    have = 1
    while have < depth:
        alone = new & np.concatenate((new[1:], [True]))
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        items = order[open_]
        key = rank[items] * (n + 2) + rank[np.minimum(items + have, n)] + 1
        by = np.argsort(key, kind="stable")
        order[open_] = items[by]
        key = key[by]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        new[open_] = fresh
        place = np.maximum.accumulate(np.where(fresh, open_, 0))
        rank[order[open_]] = place
        have *= 2
    return order


def suffix_order(text: np.ndarray, sigma: int, width: int, folder: str) -> np.ndarray:
    """Suffixes of `text` (ends in 0, the least character) in order of their first `width` characters at least."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int32)))
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    is_s = np.ones(n, bool)
    known = at < n
    is_s[:-1][known] = step[at[known]] > 0
    is_s[:-1][~known] = False
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        _, small = induce(text, is_s, lms, sigma, folder)
        leftmost = np.zeros(n, bool)
        leftmost[lms] = True
        found = np.concatenate(small)
        found = found[leftmost[found]]
        if len(found) < len(lms):  # the very last suffix is induced by none
            found = np.concatenate((lms[-1:], found[found != lms[-1]]))
        # names: equal leftmost substrings have equal length and hash
        where = np.empty(n, np.int32)
        where[lms] = np.arange(len(lms))
        stop = np.append(lms[1:], n - 1) + 1
        sums = prefix_sums(text % 257)
        size = stop[where[found]] - found
        h = (sums[found + size] - sums[found]) * power(n, True)[found]
        name = np.cumsum(np.concatenate(([0], (h[1:] != h[:-1]) | (size[1:] != size[:-1])))) if sigma <= 257 else np.arange(len(found))
        reduced = np.empty(len(lms), np.int64)
        reduced[where[found]] = name
        if name[-1] + 1 == len(lms):
            lms = found
        elif name[-1] < SMALL_ALPHABET and sigma <= 257:
            lms = lms[suffix_order_of_names(reduced, int(name[-1]) + 2, width, folder)]
        else:
            lms = lms[doubled(reduced, width // 2 + 1)]
    large, small = induce(text, is_s, lms, sigma, folder)
    return np.concatenate([x for pair in zip(large, small) for x in pair])


def suffix_order_of_names(reduced: np.ndarray, sigma: int, width: int, folder: str) -> np.ndarray:
    """The recursion, for alphabets that queues can serve: the order of all suffixes of the reduced string."""
    text = np.append(reduced + 1, 0).astype(np.int32)
    n = len(text)
    step = np.sign(np.diff(text))
    at = np.minimum.accumulate(np.where(step != 0, np.arange(n - 1), n)[::-1])[::-1]
    is_s = np.append(step[np.minimum(at, n - 2)] > 0, True)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    order = doubled(reduced, width // 2 + 1)  # of these few, the leftmost ones seed the queues
    keep = np.zeros(n, bool)
    keep[lms] = True
    seeds = np.append(n - 1, order[keep[order]]).astype(np.int32)
    large, small = induce(text, is_s, seeds, sigma, folder)
    out = np.concatenate([x for pair in zip(large, small) for x in pair])
    return out[out < n - 1]


def repeated_windows(contents: list[bytes], width: int) -> list[np.ndarray]:
    """For each content, which of its windows occur at another place of any content."""
    folder = os.environ.get("TMPDIR") or tempfile.gettempdir()
    raw = np.frombuffer(b"\x00".join([*contents, b""]), np.uint8)
    size = np.array([len(c) for c in contents], np.int64)
    ends = np.cumsum(size + 1)  # after each separator
    text = raw.astype(np.int16) + 1
    text[ends - 1] = 0
    order = suffix_order(text, 257, width, folder)
    valid = np.zeros(len(text), bool)
    windows = size - width + 1
    valid[np.arange(int(windows.sum())) + np.repeat(ends - 1 - size - (np.cumsum(windows) - windows), windows)] = True
    order = order[valid[order]]
    h = np.zeros(len(text), np.uint64)
    own = hashes(prefix_sums(text), width)
    h[: len(own)] = own
    same = h[order[1:]] == h[order[:-1]]
    found = np.zeros(len(text), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return [found[e - 1 - s : e - width] for e, s in zip(ends.tolist(), size.tolist())]


def repeated_ranges(sent_runs: DataFrame, width: int, n: int) -> DataFrame:
    """(part, digests, starts, stops): ranges to remove, packed by the text they are in."""

    def run(table: pa.Table) -> pa.Table:
        held: dict[tuple[int, bytes], dict[tuple[bytes, int], None]] = {}
        for keys, lengths, data, n_holders, digests, places in zip(*(table.column(c).to_pylist() for c in ("keys", "lengths", "data", "n_holders", "digests", "places"))):
            at = of = 0
            places_ = np.frombuffer(places, np.int64).tolist()
            for key, length, many in zip(np.frombuffer(keys, np.uint64).tolist(), np.frombuffer(lengths, np.uint32).tolist(), np.frombuffer(n_holders, np.uint32).tolist()):
                own = held.setdefault((key, data[at : at + length]), {})
                own.update(((digests[16 * k : 16 * k + 16], places_[k]), None) for k in range(of, of + many))
                at, of = at + length, of + many
        by_key: dict[int, list] = {}
        for (key, data), holders in held.items():
            by_key.setdefault(key, []).append((data, holders))
        out_d, out_a, out_b = [], [], []

        def tell(holders: dict, ranges: list) -> None:
            for d, place in holders:
                for a, b in ranges:
                    out_d.append(d)
                    out_a.append(place + a)
                    out_b.append(place + b)

        def sort(batch: list) -> None:
            for (data, holders), again in zip(batch, repeated_windows([d for d, _ in batch], width)):
                if len(holders) > 1:
                    tell(holders, [(0, len(data))])
                else:
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], again.astype(np.int8), [0]))))
                    tell(holders, [(a, b + width - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())])

        batch, size = [], 0
        for rows in by_key.values():
            if len(rows) == 1 and len(rows[0][1]) == 1 and len(rows[0][0]) == width:
                continue  # one window at one place: nothing repeats
            if len(rows) == 1 and len(rows[0][1]) > 1:
                tell(rows[0][1], [(0, len(rows[0][0]))])  # its key has no other run that could share a window, so its place in the order tells nothing more
                continue
            batch += rows
            size += sum(len(d) for d, _ in rows)
            if size > SHARD_BYTES:
                sort(batch)
                batch, size = [], 0
        if batch:
            sort(batch)
        d = np.frombuffer(b"".join(out_d), np.uint64).reshape(-1, 2)
        rows = list(packed(parts(mix(d[:, 0].copy()), n), d, np.array(out_a, np.int64), np.array(out_b, np.int64)))
        cols = list(zip(*rows)) or [()] * 4
        return pa.table({"part": pa.array(cols[0], pa.int32()), "digests": pa.array(cols[1], pa.binary()), "starts": pa.array(cols[2], pa.binary()), "stops": pa.array(cols[3], pa.binary())})

    return sent_runs.groupBy("part").applyInArrow(run, "part int, digests binary, starts binary, stops binary")


def merged_spans(ranges: DataFrame) -> DataFrame:
    """(digest, spans): maximal ranges to remove of each text, as pairs of 64-bit numbers."""

    def run(table: pa.Table) -> pa.Table:
        d = unpacked(table.column("digests"), np.uint64).reshape(-1, 2)
        a, b = unpacked(table.column("starts"), np.int64), unpacked(table.column("stops"), np.int64)
        order = np.lexsort((a, d[:, 1], d[:, 0]))
        d, a, b = d[order], a[order], b[order]
        out_d, out_s = [], []
        edges = np.flatnonzero((d[1:] != d[:-1]).any(1)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(d)] if len(d) else []):
            x, y = a[lo:hi], np.maximum.accumulate(b[lo:hi])
            new = np.concatenate(([True], x[1:] > y[:-1]))
            first = np.flatnonzero(new)
            out_d.append(d[lo].tobytes())
            out_s.append(np.stack([x[first], y[np.append(first[1:], hi - lo) - 1]], 1).tobytes())
        return pa.table({"digest": pa.array(out_d, pa.binary()), "spans": pa.array(out_s, pa.binary())})

    return ranges.groupBy("part").applyInArrow(run, "digest binary, spans binary")


def with_spans(docs: DataFrame, width: int = WIDTH, least: int | None = None) -> DataFrame:
    """`row` (the columns of `docs`), `spans` (ranges to remove; null: none) and `copies`, whether the text occurs in other rows.

    least: a smaller width whose ranges are told too, as `passages`.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string"))
    n = 1 << (n_parts(spark) - 1).bit_length()
    low, gram = (least, GRAM) if least else (width, width // 2)
    found = repeated_keys(texts, low, gram, n)
    sent = spark.sparkContext.broadcast(bitmap(found, n))
    ranges = lambda size: cut(merged_spans(repeated_ranges(runs(texts, sent, size, gram, n), size, n)))
    spans = ranges(width)
    if least:  # what a wider window repeats, narrower ones repeat
        spans = ranges(least).withColumnRenamed("spans", "passages").join(spans, "digest", "left")
    digest = lambda c: F.unhex(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")))
    copied = texts.where(F.octet_length("text") >= low).groupBy(digest(F.col("text")).alias("digest")).count()
    copied = copied.where("count > 1").select("digest", F.lit(True).alias("copies"))
    about = spans.join(copied, "digest", "full")
    nested = docs.select(F.struct("*").alias("row"))
    joined = nested.withColumn("own", digest(F.col("row.text"))).join(about.hint("shuffle_hash"), F.col("own") == F.col("digest"), "left")
    return joined.select("row", *(["passages"] if least else []), "spans", "copies")


def unnested(batch: pa.RecordBatch, columns: list[str]) -> pa.RecordBatch:
    """The columns of `row` by name, then what else the batch has, under names that no column has."""
    rest = [c for c in batch.schema.names if c != "row"]
    return pa.RecordBatch.from_arrays([*batch.column("row").flatten(), *(batch.column(c) for c in rest)], names=[*columns, *(f"\0{c}" for c in rest)])


def spans_of(text: bytes, spans: bytes | None, copies: bool | None, width: int) -> np.ndarray:
    if copies and len(text) >= width:
        return np.array([[0, len(text)]], np.int64)
    return np.frombuffer(spans or b"", np.int64).reshape(-1, 2)


def without(text: bytes, spans: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in spans.tolist():
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def worded(text: bytes, spans: np.ndarray, least_words: int) -> np.ndarray:
    """The spans of `least_words` words or more."""
    return spans[[len(text[a:b].split()) >= least_words for a, b in spans.tolist()]] if len(spans) else spans


def digest(docs: DataFrame, width: int = WIDTH, passage: int = PASSAGE_BYTES, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, n_passages, passage_bytes` of each row.

    text: the remaining bytes as text, without the rest of code points that were cut through.
    n_passages, passage_bytes: maximal ranges of repeated strings of `passage` bytes (less than `width`) that have `least_words` words or more, whether removed or not.
    """
    joined = with_spans(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), width, passage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(unnested(batch, ["doc_id", "text"])):
                rows = []
                for t, p, s, c in zip(as_bytes(part.column("text")), *(part.column(f"\0{k}").to_pylist() for k in ("passages", "spans", "copies"))):
                    spans, passages = spans_of(t, s, c, width), worded(t, spans_of(t, p, c, passage), least_words)
                    kept = without(t, spans)
                    rows.append((len(t), covered(spans), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"), len(passages), covered(passages)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    covered = lambda spans: int((spans[:, 1] - spans[:, 0]).sum())
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "n_passages", "passage_bytes"]
    types = [*[pa.int64()] * 3, *[pa.string()] * 2, *[pa.int64()] * 2]
    return joined.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, n_passages long, passage_bytes long")


def whole_points(text: bytes, spans: np.ndarray) -> np.ndarray:
    """The spans, each drawn in to whole code points."""
    out = []
    for a, b in spans.tolist():
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def deduplicated(docs: DataFrame, width: int = WIDTH, least_words: int = 0) -> DataFrame:
    """The rows of `docs`, in its columns, with repeated bytes cut out of `text`; ranges give way to whole code points.

    least_words: maximal ranges of fewer words stay.
    """
    columns = docs.columns
    joined = with_spans(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(unnested(batch, columns)):
                texts = []
                for t, s, c in zip(as_bytes(part.column("text")), part.column("\0spans").to_pylist(), part.column("\0copies").to_pylist()):
                    spans = spans_of(t, s, c, width)
                    if least_words:
                        spans = worded(t, spans, least_words)
                    texts.append(without(t, whole_points(t, spans)).decode())
                kept = part.column("text").is_null().to_pylist()
                own = pa.array([None if z else x for z, x in zip(kept, texts)], part.schema.field("text").type)
                yield pa.RecordBatch.from_arrays([own if c == "text" else part.column(c) for c in columns], names=columns)

    return joined.mapInArrow(tidy(run), docs.schema)

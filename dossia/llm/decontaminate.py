"""Benchmark decontamination by rare seeds and Smith-Waterman alignment (operator 6).

Word n-grams of the test items are counted over all documents; the rarer ones of each item are its
seeds. Every placement that reaches `least` keeps a number of the item's n-grams (`seed_plan`), so half
of that number, the commonest, are left out, and places where the other half don't lie close together
can't reach `least`. Passages around seeds in a document are aligned with the item by Smith-Waterman on
words (match 2, mismatch and gap -1), and a document is contaminated by an item if the score reaches
`least` of a perfect one.

Test items are few and short; they are sent to all tasks in blocks of at most ITEM_BYTES, one scan
a block, so what is broadcast stays bounded whatever their number. Documents aren't moved.

Null and empty texts match nothing, and so do items without words; an item's n-grams are
shorter than `gram` where that many words in a row needn't survive; repeated rows are judged each; ties between places go to the
first; an empty table on either side gives no matches; a text of any length is searched whole, aligned only
around its seeds; other columns are ignored, or kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossia.llm.kernels import U, as_bytes, mix, slices, tidy, window_starts, word_hashes

GRAM, LEAST = 3, 0.6
ITEM_BYTES = 8 << 20
MATCH, MISS, GAP = 2, -1, 1


def folded(texts: list[bytes]) -> list[bytes]:
    """Texts in lower case, letters beyond A-Z too."""
    return [t.lower() if t.isascii() else t.decode("utf-8", "replace").lower().encode() for t in texts]


def gram_hashes(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the n-grams of `width` words that begin at each place."""
    h = np.full(len(at), width, np.uint64)
    for k in range(width):
        h = mix(h ^ words[at + k])
    return h


def bar(size: int, least: float) -> int:
    """The smallest score of an item of `size` words that reaches `least`."""
    return int(np.ceil(least * MATCH * size - 1e-9))


def seed_plan(size: int, gram: int, least: float) -> tuple[int, int]:
    """The widest n-grams, of `gram` words at most, of which every placement that reaches `least` keeps some, and how many at least.

    m matched words can be broken at MATCH * m - bar places, as each mismatch or gap costs 1; the runs between
    keep m - (width - 1) * (breaks + 1) n-grams, fewest where all words match. Single words need no run.
    """
    for width in range(min(gram, size), 1, -1):
        kept = size - (width - 1) * (MATCH * size - bar(size, least) + 1)
        if kept > 0:
            return width, min(kept, size - width + 1)
    return 1, min(max(-(-bar(size, least) // MATCH), 1), size)


class Items:
    """Test items: word hashes, and their n-grams (hash, item, place) sorted by hash."""

    def __init__(self, ids: list, texts: list[bytes], gram: int, least: float):
        self.ids = ids
        texts = folded(texts)
        words, counts = word_hashes(texts)
        #: Hash of each word of the items, by which words of documents are looked up.
        self.codes = dict(zip((w for t in texts for w in t.split()), words.tolist()))
        ends = np.cumsum(counts)
        self.words = [words[e - c : e] for e, c in zip(ends.tolist(), counts.tolist())]
        plan = [seed_plan(len(w), gram, least) if len(w) else (0, 0) for w in self.words]
        #: Words of an item's n-grams, how many of them a placement keeps, and how many of those are seeds.
        self.width, self.kept = (np.array(x, np.int64) for x in zip(*plan))
        self.seeds = (self.kept + 1) // 2
        #: Words of a text that a placement covers at most: the item's and those that the score lets be inserted.
        self.cover = np.array([len(w) + max(MATCH * len(w) - bar(len(w), least), 0) // GAP for w in self.words], np.int64)
        self.lengths = sorted({w for w, _ in plan if w})
        found = []
        for width in self.lengths:
            for i, w in enumerate(self.words):
                if self.width[i] == width:
                    h = gram_hashes(w, np.arange(len(w) - width + 1), width)
                    found += [(x, i, k) for k, x in enumerate(h.tolist())]
        found.sort()
        self.hash = np.array([x for x, _, _ in found], np.uint64)
        self.item = np.array([i for _, i, _ in found], np.int64)
        self.place = np.array([k for _, _, k in found], np.int64)

    def coded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, 0 for a word of no item, and the number of words of each."""
        words, counts = [], np.empty(len(texts), np.int64)
        for i, t in enumerate(folded(texts)):
            w = t.split()
            counts[i] = len(w)
            words += w
        return np.fromiter(map(self.codes.get, words, repeat(0)), np.uint64, len(words)), counts

    def only(self, keep: np.ndarray) -> None:
        self.hash, self.item, self.place = self.hash[keep], self.item[keep], self.place[keep]


def grams_of(words: np.ndarray, counts: np.ndarray, widths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, place of the first word) of the n-grams of known words (not 0) of all texts laid end to end."""
    unknown = np.concatenate(([0], np.cumsum(words == 0)))
    for width in widths:
        at = window_starts(counts, width)
        at = at[unknown[at + width] == unknown[at]]
        yield gram_hashes(words, at, width), at


def document_counts(docs: DataFrame, sent, n: int) -> np.ndarray:
    """In how many documents each distinct n-gram of the items occurs; one row of `n` numbers a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, items = sent.value
        total = np.zeros(n, np.int64)
        for batch in batches:
            for part in slices(batch):
                words, counts = items.coded(as_bytes(part.column("text")))
                of = np.repeat(np.arange(len(counts)), counts)
                for h, at in grams_of(words, counts, items.lengths):
                    k = np.minimum(np.searchsorted(known, h), n - 1)
                    hit = known[k] == h
                    pairs = np.unique(k[hit] * (len(counts) + 1) + of[at[hit]])
                    np.add.at(total, pairs // (len(counts) + 1), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    out = np.zeros(n, np.int64)
    for k, many in docs.mapInArrow(tidy(run), "k long, n long").groupBy("k").agg(F.sum("n")).toLocalIterator():
        out[k] = many
    return out


def aligned(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of an item with each row of `windows`, and where in the row each ends first.

    Row by row of the item; gaps along the window are a running maximum.
    """
    c, w = windows.shape
    slope = GAP * np.arange(w + 1)
    before = np.zeros((c, w + 1), np.int32)
    best, end = np.zeros(c, np.int32), np.zeros(c, np.int64)
    for x in item:
        now = np.zeros((c, w + 1), np.int32)
        now[:, 1:] = np.maximum(before[:, :-1] + np.where(windows == x, MATCH, MISS), before[:, 1:] - GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope, 1) - slope
        top = now.max(1)
        better = np.flatnonzero((top >= best) & (top > 0))
        place = now[better].argmax(1)
        end[better] = np.where(top[better] > best[better], place, np.minimum(place, end[better]))
        best = np.maximum(best, top)
        before = now
    return best, end


def close_seeds(t: np.ndarray, i: np.ndarray, p: np.ndarray, items: Items) -> np.ndarray:
    """Which seeds (text, item, place) are among as many as a placement keeps, within the words that it covers."""
    order = np.lexsort((p, i, t))
    t, i, p = t[order], i[order], p[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (p[1:] != p[:-1])
    first = np.flatnonzero(new)
    own = i[first]
    last = np.arange(len(first)) + items.seeds[own] - 1
    at = first[np.minimum(last, len(first) - 1)]
    good = (last < len(first)) & (t[at] == t[first]) & (i[at] == own) & (p[at] - p[first] <= (items.cover - items.width)[own])
    change = np.zeros(len(first) + 1, np.int64)
    np.add.at(change, np.flatnonzero(good), 1)
    np.add.at(change, last[good] + 1, -1)
    return order[(np.cumsum(change)[:-1] > 0)[np.cumsum(new) - 1]]


def matches(texts: list[bytes], items: Items, least: float) -> Iterator[tuple[int, int, float, int]]:
    """(text, item, share of a perfect score, word at which the match ends) for every contaminated text and item."""
    words, counts = items.coded(texts)
    ends = np.cumsum(counts)
    of = np.repeat(np.arange(len(counts)), counts)
    texts_, items_, places_, starts_ = [], [], [], []
    for h, at in grams_of(words, counts, items.lengths):
        lo, hi = np.searchsorted(items.hash, h, "left"), np.searchsorted(items.hash, h, "right")
        hit = np.flatnonzero(hi > lo)
        many = (hi - lo)[hit]
        k = np.arange(int(many.sum())) + np.repeat(lo[hit] - (np.cumsum(many) - many), many)
        where = np.repeat(at[hit], many)
        texts_.append(of[where])
        items_.append(items.item[k])
        places_.append(where)
        starts_.append(where - items.place[k])
    if not texts_:
        return
    t, i, p, s = (np.concatenate(x) for x in (texts_, items_, places_, starts_))
    if not len(t):
        return
    near = close_seeds(t, i, p, items)
    t, i, s = t[near], i[near], s[near]
    if not len(t):
        return
    # a window reaches past the item by all words that a placement can have inserted, so the placements of
    # each of its seeds lie in it; seeds of a text and item whose diagonals are no further apart share one
    size = np.array([len(w) for w in items.words], np.int64)
    slack = items.cover - size
    order = np.lexsort((s, i, t))
    t, i, s = t[order], i[order], s[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (s[1:] - s[:-1] > slack[i[1:]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(t)) - 1
    ct, ci = t[first], i[first]
    # long runs of diagonals (a repeated passage) are cut so that windows stay in proportion to the item
    a, b = s[first] - slack[ci], s[last] + size[ci] + slack[ci]
    span = 4 * size[ci] + 4 * slack[ci]
    step = np.maximum(span - size[ci] - 2 * slack[ci], 1)
    pieces = np.maximum(1, -(-(b - a - span) // step) + 1)
    idx = np.repeat(np.arange(len(ct)), pieces)
    a = a[idx] + (np.arange(len(idx)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * step[idx]
    b = np.minimum(b[idx], a + span[idx])
    ct, ci = ct[idx], ci[idx]
    a, b = np.maximum(a, (ends - counts)[ct]), np.minimum(b, ends[ct])
    found: dict[tuple[int, int], tuple[float, int]] = {}
    for item in np.unique(ci).tolist():
        own = np.flatnonzero(ci == item)
        word = items.words[item]
        own = own[np.argsort(b[own] - a[own], kind="stable")]
        for part in np.array_split(own, -(-len(own) // 256)):
            width = int((b[part] - a[part]).max())
            at = a[part][:, None] + np.arange(width)
            inside = at < b[part][:, None]
            window = np.where(inside, words[np.minimum(at, len(words) - 1)], U(0))
            # an alignment can't score more than its common words
            top = MATCH * np.minimum(np.isin(window, word).sum(1), len(word))
            keep = top >= least * MATCH * len(word)
            if not keep.any():
                continue
            part, window = part[keep], window[keep]
            score, end = aligned(word, window)
            share = score / (MATCH * len(word))
            for k in np.flatnonzero(share >= least).tolist():
                key, got = (int(ct[part[k]]), item), (float(share[k]), int(a[part[k]] + end[k] - (ends - counts)[ct[part[k]]]))
                if key not in found or (got[0], -got[1]) > (found[key][0], -found[key][1]):
                    found[key] = got
    for (text, item), (share, end) in sorted(found.items()):
        yield text, item, share, end


def blocks_of(benchmark: DataFrame, gram: int, least: float) -> Iterator[Items]:
    """The items in blocks of ITEM_BYTES of text at most (one longer item is a block of its own)."""
    ids, texts, size = [], [], 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        raw = (text or "").encode()
        if size and size + len(raw) > ITEM_BYTES:
            yield Items(ids, texts, gram, least)
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(raw)
        size += len(raw)
    if ids:
        yield Items(ids, texts, gram, least)


def seeded(docs: DataFrame, benchmark: DataFrame, gram: int, least: float) -> Iterator[Items]:
    """Blocks of items whose n-grams are down to the rarer ones of each item, without those that no placement needs."""
    sc = docs.sparkSession.sparkContext
    for items in blocks_of(benchmark, gram, least):
        if not len(items.hash):
            continue
        known, back = np.unique(items.hash, return_inverse=True)
        n = document_counts(docs.select(F.col("text").cast("string")), sc.broadcast((known, items)), len(known))[back]
        keep = np.zeros(len(n), bool)
        order = np.lexsort((n, items.item))
        edges = np.flatnonzero(np.diff(items.item[order])) + 1
        for own in np.split(order, edges):
            i = items.item[own[0]]
            keep[own[: len(own) - items.kept[i] + items.seeds[i]]] = True
        items.only(keep)
        yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, least: float = LEAST) -> DataFrame:
    """`doc_id, item_id, score, end_word` for each document and item that match."""
    schema = "doc_id long, item_id long, score double, end_word long"
    out = None
    for items in seeded(docs, benchmark, gram, least):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    ids = part.column("doc_id").to_pylist()
                    rows = [(ids[t], sent.value.ids[i], score, end) for t, i, score, end in matches(as_bytes(part.column("text")), sent.value, least)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["doc_id", "item_id", "score", "end_word"])

        got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), schema)
        out = got if out is None else out.unionByName(got)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, least: float = LEAST) -> DataFrame:
    """The rows of `docs`, in its columns, that no item contaminates."""
    for items in seeded(docs, benchmark, gram, least):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    keep = np.ones(part.num_rows, bool)
                    for t, _, _, _ in matches(as_bytes(part.column("text")), sent.value, least):
                        keep[t] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs

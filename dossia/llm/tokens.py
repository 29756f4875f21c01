"""Token counts by rank-synchronous merging of ragged arrays (operator 5).

Pre-tokens that aren't known yet are gathered for a slice of texts and laid out as one flat
array of symbols with sequence starts. In each round every sequence finds the lowest rank
among its adjacent pairs and merges all its occurrences of that pair at once; sequences
without a mergeable pair leave with the number of symbols that survive.

Nulls and empty texts have no bytes and no tokens; repeated rows are counted each; ties in
rank within a sequence are one pair, whose overlapping occurrences merge from the left. Other
columns of the input play no part. A text of any length is counted whole, as a slice of its own; an
empty table gives no rows. Special strings inside a text are one token each, which is
the library's default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossia.llm.kernels import as_bytes, slices, tidy

#: How byte-level BPE splits text before merging (a public, fixed pattern).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of these characters only, in a form that the plain engine runs faster.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
ONLY_LATIN = re.compile(f"[\\x00-\\x7f{LATIN}]*")
SPLIT_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\t-\r 0-9{LATIN}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
CACHE = 300_000
NONE = np.int64(2**40)


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Merger:
    """The merges of a vocabulary, as a sorted array of pairs with rank and result."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.first = np.zeros(256, np.int64)
        for c, b in byte_symbols().items():
            self.first[b] = vocab[c]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_at = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def counts(self, sequences: list[bytes]) -> np.ndarray:
        """Surviving symbols of each byte sequence."""
        out = np.array([len(s) for s in sequences], np.int64)
        live = np.flatnonzero(out > 1)
        if not len(live):
            return out
        sizes = out[live]
        symbols = self.first[np.frombuffer(b"".join(sequences[i] for i in live.tolist()), np.uint8)]
        while len(live):
            owner = np.repeat(np.arange(len(live)), sizes)
            keys = symbols[:-1] << 20 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.full(len(symbols), NONE)
            rank[:-1] = np.where((self.keys[at] == keys) & (owner[:-1] == owner[1:]), self.rank[at], NONE)
            starts = np.cumsum(sizes) - sizes
            lowest = np.minimum.reduceat(rank, starts)
            hit = np.flatnonzero((rank == lowest[owner]) & (rank < NONE))
            if len(hit):
                # of occurrences that overlap, every second one of a run merges
                run = np.concatenate(([True], np.diff(hit) != 1))
                begun = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - begun) % 2 == 0]
                symbols[hit] = self.made[at[hit]]
                keep = np.ones(len(symbols), bool)
                keep[hit + 1] = False
                symbols, owner = symbols[keep], owner[keep]
                sizes = np.bincount(owner, minlength=len(live))
            done = (lowest == NONE) | (sizes == 1)
            if done.any():
                out[live[done]] = sizes[done]
                symbols = symbols[~done[owner]]
                live, sizes = live[~done], sizes[~done]
        return out


class Known(dict):
    """Counts of pre-tokens; those not known yet are noted and count 0 for the moment."""

    def __init__(self):
        super().__init__()
        self.new: set[str] = set()
        self.misses = 0

    def __missing__(self, piece: str) -> int:
        self.new.add(piece)
        self.misses += 1
        return 0


class Counter:
    """Token counts of texts, with a bounded memory of pre-tokens."""

    def __init__(self, path: str):
        self.merger, self.split, self.known = Merger(path), regex.compile(SPLIT), Known()

    def count(self, texts: list[str]) -> list[int]:
        out, cuts, again = [], [], []
        if len(self.known) > CACHE:
            self.known.clear()
        get = self.known.__getitem__
        for i, t in enumerate(texts):
            cut = self.merger.special_at.split(t) if any(x in t for x in self.merger.special) else [t]
            findall = SPLIT_LATIN.findall if ONLY_LATIN.fullmatch(t) else self.split.findall
            pieces = findall(t) if len(cut) == 1 else [p for c in cut for p in findall(c)]
            before = self.known.misses
            out.append(len(cut) - 1 + sum(map(get, pieces)))
            if self.known.misses > before:
                again.append(i)
                cuts.append((len(cut) - 1, pieces))
        new = list(self.known.new)
        self.known.new.clear()
        self.known.update(zip(new, self.merger.counts([p.encode() for p in new]).tolist()))
        for i, (n, pieces) in zip(again, cuts):
            out[i] = n + sum(map(get, pieces))
        return out


_counters: dict[str, Counter] = {}


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 512) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` of each row of `df`.

    tokenizer: the place of a byte-level BPE vocabulary file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.setdefault(tokenizer, None) or Counter(tokenizer)
        _counters[tokenizer] = counter
        for batch in batches:
            for part in slices(batch):
                raw = as_bytes(part.column("text"))
                n = np.array(counter.count([b.decode("utf-8", "replace") for b in raw]), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(b) for b in raw], pa.int64()), pa.array(n), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kept = df.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text"))
    return kept.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

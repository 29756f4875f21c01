"""Line sequence labelling for quality (operator 8).

A linear-chain conditional random field over the lines of a text has two labels, boilerplate (0)
and content (1). Viterbi decoding marks the lines; a text is kept if the share of its word
characters in content lines is at least `share`, unless a base rule rejects it.

The field is trained here from document labels, on at most `sample` labelled documents of `sample_bytes`
bytes together (a documented bound, chosen by a hash of doc_id). A line's label is what its own features
say: a first field without neighbours learns from the label of each line's document, and the lines that
it takes for content, in good documents or bad, are the second's content. Everything else reads all
rows and whole texts.

Null texts have no words and fail the base rule; repeated rows are judged each; without labels of
both kinds every text that passes the base rules is kept; an empty table gives no rows; a text of any
length is judged by all its lines; other columns are ignored. A tie in Viterbi decoding goes to content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossia.llm.kernels import as_bytes, mix, slices, tidy, window_hashes, window_starts, word_hashes

SAMPLE, SAMPLE_BYTES, SHARE = 3000, 64 << 20, 0.5
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"

#: The class of each byte: exactly one, in this order.
KINDS = ["other", "space", "symbol", "upper", "lower", "digit", "inner", "punct", "bang"]
_b = np.arange(256)
KIND = np.select(
    [np.isin(_b, [9, 10, 11, 12, 13, 32]), np.isin(_b, list(b"#*$%&|<>")), (_b >= 65) & (_b <= 90), (_b & 0xC0) == 0x80, (_b >= 97) & (_b <= 122) | (_b >= 192), (_b >= 48) & (_b <= 57), _b == 33, np.isin(_b, list(b"?.,;:"))],
    [1, 2, 3, 6, 4, 5, 8, 7],
    0,
).astype(np.uint8)


class Lines:
    """The lines of texts, with counts of bytes by class: `n[kind]`, the text of each, and places in `data`."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)  # every text ends in a line end
        self.ends = np.flatnonzero(self.data == 10)
        self.starts = np.concatenate(([0], self.ends[:-1] + 1)) if len(self.ends) else self.ends
        self.of = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
        self.owner = np.repeat(np.arange(len(texts)), self.of)
        line = np.repeat(np.arange(len(self.ends)), self.ends - self.starts + 1)
        found = np.bincount(line * len(KINDS) + KIND[self.data], minlength=len(self.ends) * len(KINDS)).reshape(-1, len(KINDS))
        found[:, 1] -= 1  # the line end itself
        self.n = dict(zip(KINDS, found.T))
        self.chars = found.sum(1) - self.n["space"] - self.n["inner"]

    def by_text(self, values: np.ndarray) -> np.ndarray:
        ends = np.cumsum(self.of)
        return sums(values, ends - self.of, ends)

    def seen(self) -> np.ndarray:
        """Whether a line with a word equals an earlier one of its text."""
        out = []
        for t in self.texts:
            known: set[bytes] = set()
            for x in t.split(b"\n"):
                out.append(x in known)
                known.add(x)
        return np.array(out, bool) & (self.chars > 0)


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end]."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, 0, dtype=np.int64)))
    return total[ends] - total[starts]


def base_columns(lines: Lines, seen: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    texts = lines.texts
    words, counts = word_hashes(texts)
    chars, symbols, dup = lines.by_text(lines.chars), lines.by_text(lines.n["symbol"]), lines.by_text(seen)
    hashes, have = window_hashes(words, counts, 5)
    starts = window_starts(counts, 5)
    repeated = np.zeros(len(texts), np.int64)
    if len(hashes):
        own = mix(hashes + np.repeat(mix(np.arange(1, len(texts) + 1, dtype=np.uint64)), have))
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        twice = np.zeros(len(own), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(words) + 6, np.int32)
        np.add.at(edge, starts[twice], 1)
        np.add.at(edge, starts[twice] + 5, -1)
        first = np.cumsum(counts) - counts
        repeated = sums(np.cumsum(edge)[: len(words)] > 0, first, first + counts)
    failed = (counts < 10) | (100 * repeated > 20 * counts)
    return {"n_words": counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeated, "base_failed": failed}


def bins(share: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(edges), share, "right")


#: Edges of the bins of each line feature, after which the number of features follows.
EDGES = {"symbol": [1e-9, 0.02, 0.08, 0.15], "upper": [0.02, 0.1, 0.3, 0.6], "digit": [1e-9, 0.05, 0.2], "bang": [1e-9, 0.02, 0.1], "length": [20, 60, 200, 800], "word": [3, 5, 7, 10], "punct": [1e-9, 0.01, 0.03, 0.08], "seen": [0.5], "ends": [0.5]}
N_FEATURES = 1 + sum(len(e) + 1 for e in EDGES.values())


def features_of(lines: Lines, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word: feature indices (lines x features), lines of each text, word characters of each line."""
    n, chars = lines.n, lines.chars
    keep = chars > 0
    last = lines.data[np.maximum(lines.ends - 1, 0)] if len(lines.ends) else lines.ends
    size = np.maximum(chars, 1)
    punct = n["punct"] + n["bang"]
    columns = {"symbol": n["symbol"] / size, "upper": n["upper"] / size, "digit": n["digit"] / size, "bang": n["bang"] / size, "length": chars, "word": chars / (n["space"] + 1), "punct": punct / size, "seen": seen, "ends": np.isin(KIND[last], (7, 8))}
    out, at = [np.zeros(len(chars), np.int64)], 1
    for name, edges in EDGES.items():
        out.append(at + bins(columns[name], edges))
        at += len(edges) + 1
    return np.stack(out, 1)[keep], lines.by_text(keep), chars[keep]


def by_step(counts: np.ndarray) -> Iterator[np.ndarray]:
    """For t = 0, 1, ...: the rows, of chains laid end to end, at place t of every chain that is so long; longest chains first."""
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    length = counts[order]
    for t in range(int(length[0]) if len(length) else 0):
        yield first[: np.searchsorted(-length, -t, "left")] + t


class Field:
    """A linear chain with two labels: weights of features for content, and four transition weights."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros(N_FEATURES) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves

    def scores(self, features: np.ndarray) -> np.ndarray:
        s = self.weights[features].sum(1)
        return np.stack([-s / 2, s / 2], 1)

    def decode(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The best label of each line (Viterbi over all chains in step)."""
        s = self.scores(features)
        back = np.zeros((len(s), 2), np.int8)
        steps = list(by_step(counts))
        best = None
        finals = np.empty((len(s), 2))
        for rows in steps:
            if best is None:
                best = s[rows]
            else:
                come = best[: len(rows), :, None] + self.moves
                back[rows] = (come[:, 1] >= come[:, 0]).astype(np.int8)
                best = come.max(1) + s[rows]
            finals[rows] = best
        labels = np.zeros(len(s), np.int8)
        state = np.zeros(0, np.int8)
        for rows in reversed(steps):
            new = rows[len(state) :]
            state = np.concatenate((state, (finals[new, 1] >= finals[new, 0]).astype(np.int8)))
            labels[rows] = state
            state = back[rows, state]
        return labels

    def fit(self, features: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 80, rate: float = 0.15, l2: float = 1e-3) -> Field:
        """Gradient ascent (Adam) on the conditional likelihood by forward-backward sums."""
        steps = list(by_step(counts))
        n = max(1, len(labels))
        m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
        pairs = np.zeros((2, 2))
        for a, b in zip(steps, steps[1:]):
            np.add.at(pairs, (labels[a[: len(b)]], labels[b]), 1)
        seen = np.bincount(features.ravel(), np.repeat(labels, features.shape[1]), N_FEATURES)
        for k in range(1, rounds + 1):
            s = self.scores(features)
            ahead, behind = np.empty_like(s), np.zeros_like(s)
            before = None
            for rows in steps:
                ahead[rows] = s[rows] if before is None else s[rows] + np.logaddexp.reduce(ahead[before[: len(rows)], :, None] + self.moves, 1)
                before = rows
            expected = np.zeros((2, 2))
            for a, b in zip(steps[-2::-1], steps[:0:-1]):
                x = self.moves + (s[b] + behind[b])[:, None, :]
                behind[a[: len(b)]] = np.logaddexp.reduce(x, 2)
                joint = ahead[a[: len(b)], :, None] + x
                joint -= np.logaddexp.reduce(joint, (1, 2), keepdims=True)
                expected += np.exp(joint).sum(0)
            both = ahead + behind
            p = np.exp(both[:, 1] - np.logaddexp.reduce(both, 1))
            grad = (seen - np.bincount(features.ravel(), np.repeat(p, features.shape[1]), N_FEATURES)) / n - l2 * self.weights
            g = np.concatenate((grad, ((pairs - expected) / n - l2 * self.moves).ravel()))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            self.weights = self.weights + step[:-4]
            self.moves = self.moves + step[-4:].reshape(2, 2)
        return self


def content_shares(field: Field, lines: Lines, seen: np.ndarray) -> np.ndarray:
    """Share of word characters in content lines; 1 where there is no line."""
    features, counts, chars = features_of(lines, seen)
    good = field.decode(features, counts) == 1
    ends = np.cumsum(counts)
    total = sums(chars, ends - counts, ends)
    return np.where(total > 0, sums(chars * good, ends - counts, ends) / np.maximum(total, 1), 1.0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Field:
    """A field from at most `sample` labelled documents, of `sample_bytes` bytes together."""
    some = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("l_id"), "quality")
    some = some.orderBy(F.xxhash64("l_id"), "l_id", "quality").limit(sample)
    own = docs.select(F.col("doc_id").cast("long").alias("d_id"), F.col("text").cast("string").alias("d_text"))
    # repeated ids: in a full order, as many rows as labels; their first `sample_bytes` bytes reach the driver
    rows = own.join(F.broadcast(some), F.col("d_id") == F.col("l_id")).withColumn("size", F.octet_length("d_text"))
    rows = rows.orderBy(F.xxhash64("l_id"), "l_id", "quality", F.xxhash64("d_text"), "d_text").limit(sample)
    texts, labels_, left = [], [], sample_bytes
    for r in rows.select("d_text", "quality", "size").toLocalIterator():
        left -= r[2] or 0
        if left < 0:
            break
        texts.append((r[0] or "").encode())
        labels_.append(int(r[1]))
    quality = np.array(labels_, np.int64)
    if len(set(quality.tolist())) < 2:
        field = Field()
        field.weights[0] = 1.0  # everything is content
        return field
    lines = Lines(texts)
    features, counts, _ = features_of(lines, lines.seen())
    # what a line says by itself, learnt with every line a chain of its own; the field learns from these labels
    alone = Field().fit(features, np.ones(len(features), np.int64), np.repeat(quality, counts)).scores(features)
    return Field().fit(features, counts, (alone[:, 1] >= alone[:, 0]).astype(np.int64))


def judged(docs: DataFrame, field: Field, share: float = SHARE, keep_columns: bool = False) -> DataFrame:
    """Base counts and verdict of each row: `doc_id, n_words, ..., base_failed, content_share, kept`.

    With keep_columns, the rows of `docs` that are kept, unchanged, instead.
    """
    sent = docs.sparkSession.sparkContext.broadcast((field.weights, field.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*sent.value)
        for batch in batches:
            for part in slices(batch):
                lines = Lines(as_bytes(part.column("text")))
                seen = lines.seen()
                base, share_of = base_columns(lines, seen), content_shares(own, lines, seen)
                kept = ~base["base_failed"] & (share_of >= share)
                if keep_columns:
                    yield part.filter(pa.array(kept))
                else:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, base.values()), pa.array(share_of), pa.array(kept)], names=["doc_id", *base, "content_share", "kept"])

    if keep_columns:
        return docs.mapInArrow(tidy(run), docs.schema)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), BASE + ", content_share double, kept boolean")

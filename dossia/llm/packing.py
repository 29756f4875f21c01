"""Hierarchical multi-length packing (operator 7).

Context-size tiers are powers of two up to the window. A document's full windows become sequences
of their own; the rest goes to the smallest tier that holds it. In each tier the rests are laid end
to end in a fixed order and cut into sequences of exactly the tier's size, so nothing is padded but
what is left at a tier's end: those last gaps are filled from the shorter tiers, longest first, and
the last tokens of all are cut into powers of two. Sequences get a step group such that each
group has every tier in the proportion of the whole.

Texts are tokenised once, into a table of ids in the shared folder. The order within a tier is
(part of that table, row), so places are prefix sums: each row is stored with its part and with what
comes before it there, tokens are counted per part and tier (a few numbers a part reach the driver),
and each row then adds its part's offset and cuts. Nothing is shuffled, a lost task is redone from its
part alone, and the result can be coalesced or used twice.

Null and empty texts have one token (the end token); repeated rows are packed each; an empty table
gives no pieces; a text of any length is tokenised whole and cut over as many sequences as it needs;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossia.llm.kernels import as_bytes, slices, tidy, written

WINDOW, SMALLEST = 4096, 256
WORDS, PIECES = 50_000, 300_000
#: Up to so many parts of the table of ids have their offsets broadcast (80 bytes each).
SENT_PARTS = 1_000_000
#: Pre-tokens that are looked up as one line.
LINE = 256
#: Texts of these characters only are normalised by lower case alone, and split the same way by the plain engine.
LATIN = "a-zß-öø-ÿ"
ONLY_LATIN = re.compile("[\\x00-\\x7fÀ-ÖØ-öø-ÿ]*")
SPLIT_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\t-\r 0-9{LATIN}]+")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step long"


class WordIds(dict):
    """Ids of white-space separated words, as little-endian bytes.

    The vocabulary's normaliser and splitter never let a token span white space, so a text's ids are
    those of its words.
    """

    def __init__(self, tokenizer, limit: int, apart: bool):
        """Remembers up to `limit` words, and those in use before as many again; `apart`: words are pre-tokens."""
        super().__init__()
        self.tokenizer = tokenizer
        small = self.tokenizer.get_vocab_size() < 2**16
        self.dtype, self.code = ("<u2", "H") if small else ("<u4", "I")

        self.before: dict[str, bytes] = {}
        self.limit, self.apart = limit, apart

    def learn(self, new: list[str]) -> None:
        """Looks up words that aren't known."""
        step = LINE if self.apart else 20_000
        for lo in range(0, len(new), step):
            some = new[lo : lo + step]
            if not (self.apart and self.learn_line(some)):
                for w, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False)):
                    self[w] = array(self.code, e.ids).tobytes()

    def learn_line(self, some: list[str]) -> bool:
        """Looks up pre-tokens as one line with blanks between; false if the line's pre-tokens aren't one each."""
        e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
        ids, of = np.array(e.ids, self.dtype), np.array(e.word_ids, np.int64)
        if not len(of) or of[-1] + 1 != len(some):
            return False
        raw, width, lo = ids.tobytes(), ids.itemsize, 0
        for w, hi in zip(some, (width * np.searchsorted(of, np.arange(1, len(some) + 1))).tolist()):
            self[w] = raw[lo:hi]
            lo = hi
        return True

    def joined(self, cuts: list[list[str]]) -> list[bytes]:
        if len(self) > self.limit:
            self.before = dict(self)
            self.clear()
        unknown = set().union(*cuts).difference(self)
        if self.before:
            kept = unknown & self.before.keys()
            self.update(zip(kept, map(self.before.__getitem__, kept)))
            unknown -= kept
        self.learn(list(unknown))
        get = self.__getitem__
        return [b"".join(map(get, c)) for c in cuts]


_ids: dict[str, tuple[WordIds, WordIds]] = {}


def token_ids(path: str, texts: list[bytes], end_id: int) -> tuple[list[bytes], str]:
    """Ids of each text and the end id, as bytes of the type that comes second.

    Latin texts are looked up by pre-token, others by white-space separated word; texts with special
    strings by word too, as the library finds those before it normalises.
    """
    if path not in _ids:
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        library = Tokenizer.from_file(path)
        _ids[path] = (WordIds(library, PIECES, True), WordIds(library, WORDS, False))
    pieces, words = _ids[path]
    end = np.array([end_id], pieces.dtype).tobytes()
    cut, plain = [], []
    for raw in texts:
        t = raw.decode("utf-8", "replace")
        plain.append(bool(ONLY_LATIN.fullmatch(t)) and "<|" not in t)
        cut.append(SPLIT_LATIN.findall(t.lower()) if plain[-1] else [w.decode("utf-8", "replace") for w in raw.split()])
    by_piece, by_word = iter(pieces.joined([c for c, p in zip(cut, plain) if p])), iter(words.joined([c for c, p in zip(cut, plain) if not p]))
    return [next(by_piece if p else by_word) + end for p in plain], pieces.dtype


def tiers(window: int, smallest: int) -> list[int]:
    out = [window]
    while out[-1] > smallest:
        out.append(out[-1] // 2)
    return out  # longest first


def tier_of(rest: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Index of the smallest tier that holds each rest (0 for the window; rests are over 0)."""
    out = np.zeros(len(rest), np.int64)
    for k, size in enumerate(sizes):
        out[rest <= size] = k
    return out


def layout(totals: list[int], sizes: list[int]) -> list[list[tuple[int, int, int, int]]]:
    """Where each tier's stream goes: runs (from, to, first sequence, its size) per tier.

    Longest tier first: whole sequences of its own, then its last gap is filled by the heads of the
    shorter tiers' streams; the final tokens are cut into powers of two of their own.
    """
    runs: list[list[tuple[int, int, int, int]]] = [[] for _ in sizes]
    taken, sequence = [0] * len(sizes), 0
    for k, size in enumerate(sizes):
        own = totals[k] - taken[k]
        whole = own // size
        if whole:
            runs[k].append((taken[k], taken[k] + whole * size, sequence, size))
            sequence, taken[k] = sequence + whole, taken[k] + whole * size
        left = totals[k] - taken[k]
        if not left:
            continue
        shorter = sum(totals[j] - taken[j] for j in range(k + 1, len(sizes)))
        if left + shorter >= size:
            at = 0
            for j in range(k, len(sizes)):
                n = min(totals[j] - taken[j], size - at)
                if n:
                    runs[j].append((taken[j], taken[j] + n, sequence, -at))  # at an offset of one sequence
                    taken[j], at = taken[j] + n, at + n
            sequence += 1
        else:
            power = size
            while power:
                # one sequence of `power` tokens from what is left of this tier, then the shorter ones
                rest = sum(totals[j] - taken[j] for j in range(k, len(sizes)))
                if rest >= power:
                    at = 0
                    for j in range(k, len(sizes)):
                        n = min(totals[j] - taken[j], power - at)
                        if n:
                            runs[j].append((taken[j], taken[j] + n, sequence, -at))
                            taken[j], at = taken[j] + n, at + n
                    sequence += 1
                else:
                    power //= 2
    return runs


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, smallest: int = SMALLEST, step_tokens: int = 1 << 20, extra_ids: bool = False) -> DataFrame:
    """One row for each piece: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step`.

    tokenizer: the place of the vocabulary file on every executor. With extra_ids the pieces' ids follow.
    """
    sizes = tiers(window, smallest)
    T = len(sizes)
    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, whole, at = TaskContext.get().partitionId(), 0, np.zeros(T, np.int64)
        for batch in batches:
            for part in slices(batch):
                ids, dtype = token_ids(tokenizer, as_bytes(part.column("text")), end_id)
                width = int(dtype[-1])
                n = np.array([len(x) // width for x in ids], np.int64)
                rest, full = n % window, n // window
                tier = tier_of(rest, sizes)
                # how many full windows, and tokens of the row's own tier, come before it in its part
                before_whole, before = whole + np.cumsum(full) - full, np.zeros(len(n), np.int64)
                for k in range(T):
                    own = np.where(tier == k, rest, 0)
                    sums = np.cumsum(own)
                    before += np.where(tier == k, at[k] + sums - own, 0)
                    at[k] += sums[-1]
                whole += int(full.sum())
                columns = [part.column("doc_id"), pa.array(n), pa.array([width] * len(n), pa.int32()), pa.array([p] * len(n), pa.int32()), pa.array(before_whole), pa.array(before), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "width", "p", "before_whole", "before", "ids"])

    stored = written(kept.mapInArrow(tidy(tokenise), "doc_id long, n long, width int, p int, before_whole long, before long, ids binary"), "ids")
    rest = F.col("n") % window
    bounds = [(0 if k + 1 == T else sizes[k + 1], size) for k, size in enumerate(sizes)]
    sums = [F.sum(F.when((rest > lo) & (rest <= hi), rest).otherwise(0)).alias(f"t{k}") for k, (lo, hi) in enumerate(bounds)]
    # a row for each part of the table of ids
    found = stored.groupBy("p").agg(F.sum(F.expr(f"n div {window}")).alias("whole"), *sums).toPandas().sort_values("p")
    counts = found[["whole", *(f"t{k}" for k in range(T))]].to_numpy(np.int64).reshape(-1, T + 1)
    bases = np.cumsum(counts, 0) - counts
    totals = counts.sum(0).tolist()
    w, s = totals[0], totals[1:]
    runs = layout(s, sizes)
    n_steps = max(1, -(-(w * window + sum(s)) // step_tokens))
    many = [max(1, sum((b - a) // size for a, b, _, size in r if size > 0)) for r in runs]
    rows_ = [(int(p), int(x[0]), x[1:].tolist()) for p, x in zip(found["p"].to_numpy(), bases)]
    places = docs.sparkSession.createDataFrame(rows_, "b_p int, base_whole long, base array<long>")
    # 80 bytes for each part: sent to all while that is little, joined otherwise
    places = F.broadcast(places) if len(rows_) <= SENT_PARTS else places
    placed = stored.join(places, F.col("p") == F.col("b_p")).drop("p", "b_p")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                out = []
                columns = ("doc_id", "n", "width", "ids", "before_whole", "before", "base_whole", "base")
                for doc, n, width, raw, before_whole, before, base_whole, base in zip(*(part.column(c).to_pylist() for c in columns)):
                    ids, at_whole = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes(), base_whole + before_whole
                    for k in range(n // window):
                        piece = ids[4 * k * window : 4 * (k + 1) * window]
                        out.append((doc, k * window, window, zlib.crc32(piece), n, -1 - at_whole, 0, window, at_whole * n_steps // max(1, w), piece))
                        at_whole += 1
                    if n % window:
                        start, k = n - n % window, int(tier_of(np.array([n % window]), sizes)[0])
                        lo = base[k] + before
                        hi = lo + n % window
                        for a, b, sequence, size in runs[k]:
                            x = max(a, lo)
                            while x < min(b, hi):
                                if size > 0:
                                    index, off = divmod(x - a, size)
                                    y = min(b, hi, x - off + size)
                                    step = index * n_steps // many[k]
                                else:
                                    index, off, y, step = 0, x - a - size, min(b, hi), n_steps - 1
                                piece = ids[4 * (start + x - lo) : 4 * (start + y - lo)]
                                out.append((doc, start + x - lo, y - x, zlib.crc32(piece), n, sequence + index, off, sizes[k], step, piece))
                                x = y
                    if len(out) >= 10_000:
                        yield rows(out)
                        out = []
                if out:
                    yield rows(out)

    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"]

    def rows(out: list) -> pa.RecordBatch:
        cols = list(zip(*out))[: len(names) - (not extra_ids)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names[: len(cols)])

    return placed.mapInArrow(tidy(place), SCHEMA + ", ids binary" * extra_ids)

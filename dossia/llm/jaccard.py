"""N-gram Jaccard join by vertical partitioning (operator 1).

Texts become sets of five-word shingles. Two texts link when their sets' Jaccard similarity is at
least `percent`/100. The global n-gram order (frequent ones last, the rest by hash) is cut into
fragments; overlaps are counted fragment by fragment and summed for each pair.

1. Equal sets are one class, known by a 64-bit key of the set, so copies take part once.
2. Every class posts the shingles of its prefix in the global order, so long a one that two classes that
   link share several (1 + size // MARGIN of the smaller); a class with fewer shared ones links with nothing.
   Frequency is counted over all texts in every slice of the scan and summed; it only decides the order.
3. Of the classes that share a posted shingle, the one with most such partners is the shingle's hub.
   Classes meet in the groups of their hubs, each pair of classes that shares a shingle in at least
   one; large groups are split into blocks, and every pair of blocks is a task's work.
4. A task counts overlaps fragment by fragment, from an inverted index of the fragment's shingles, and
   sums the partial counts per pair. It gives a spanning forest of the links it found and each
   class's number of links, not all pairs; a pair that meets in several groups counts in the one of the
   smallest hub. Distributed connected components give the classes.

Fragments are summed in the task where their sets meet, not in a second shuffle: a hot group's partial
counts are quadratic in the group and mustn't be written out.

Null and word-less texts have an empty set and link with nothing; fewer than five words are one
shingle; repeated rows and equal texts share a class; rows without doc_id count as members but
don't name a component (it is null if no member has an id); an empty table gives no rows; a text of
any length is hashed whole, by itself in a slice if it is long; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from dossia.llm.kernels import as_bytes, components, cut, mix, n_parts, packed, parts, shingle_sets, slices, tidy, unpacked, written

PERCENT, WIDTH = 75, 5
MARGIN = 12
FRAGMENTS = 8
#: At most so many shingles are ordered by frequency (8 bytes each are broadcast); a shingle must occur so often.
HOT, HOT_LEAST = 1 << 19, 32
#: Bytes of sets and number of sets in a block of a group.
BLOCK_BYTES, BLOCK_SETS = 8 << 20, 1200
#: Up to so many ids of texts that meet others are broadcast to filter the scan; beyond it they are joined.
SENT_IDS = 2_000_000


def set_key(s: np.ndarray) -> int:
    """A 64-bit key of a set, never 0 for a set with members."""
    total = (int(mix(s).sum()) + len(s) * 0x9E3779B97F4A7C15) % 2**64
    return int(mix(np.array([total], np.uint64))[0]) or 1 if len(s) else 0


def margin(n):
    """How many posted shingles two sets of `n` or more must share."""
    return 1 + n // MARGIN


def prefix(s: np.ndarray, hot: np.ndarray, percent: int) -> np.ndarray:
    """The members of a set that are posted: the first n - ceil(percent n) + margin(n) in the global order."""
    n = len(s)
    need = n - -(-percent * n // 100) + margin(n)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        frequent = hot[at] == s
        if frequent.any():
            plain = s[~frequent]
            return plain[:need] if len(plain) >= need else np.concatenate((plain, s[frequent][: need - len(plain)]))
    return s[:need]


def lower(texts: list[bytes]) -> list[bytes]:
    return [t.lower() for t in texts]  # bytes.lower() changes A-Z alone


def documents_with_keys(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, key, bytes of the set) of each row, and (shingle, count) of those met again within a slice, from one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, pending, seen = pa.nulls, [], 0
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(lower(as_bytes(part.column("text"))), width)
                keys = np.array([set_key(s) for s in sets], np.uint64)
                n = len(sets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys.view(np.int64)), none(n, pa.int64())], names=names)
                _, own = np.unique(keys, return_index=True)
                pending += [sets[i] for i in own.tolist()]
                seen += sum(len(sets[i]) for i in own.tolist())
                if seen > 1 << 20:
                    yield again(pending)
                    pending, seen = [], 0
        if pending:
            yield again(pending)

    def again(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        values, counts = values[counts > 1], counts[counts > 1]
        return pa.RecordBatch.from_arrays([pa.nulls(len(values), pa.int64()), pa.array(counts.astype(np.int64)), pa.nulls(len(values), pa.int64()), pa.array(values.view(np.int64))], names=names)

    names = ["doc_id", "n", "key", "shingle"]
    both = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, n long, key long, shingle long"), "sets")
    return both.where("key is not null").select("doc_id", "n", "key"), both.where("key is null").select("shingle", "n")


def frequent(counts: DataFrame) -> np.ndarray:
    """The most frequent shingles, sorted; at most HOT of them, by classes of counts."""
    summed = counts.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST).withColumn("level", F.floor(F.log2("n")).cast("int"))
    summed = cut(summed)
    levels = {r[0]: r[1] for r in summed.groupBy("level").count().collect()}  # 60 rows at most
    total, least = 0, 99
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > HOT:
            break
        least = level
    got = summed.where(F.col("level") >= least).select("shingle").toPandas()["shingle"].to_numpy(np.int64)
    return np.sort(got.view(np.uint64))


def postings(docs: DataFrame, hot, width: int, percent: int, n: int) -> DataFrame:
    """(part, shingles, keys): posted shingles of all classes, packed by ranges of the shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        shingles, keys, held = [], [], 0
        for batch in batches:
            for part in slices(batch):
                for s in shingle_sets(lower(as_bytes(part.column("text"))), width):
                    if (key := set_key(s)) and key not in known:
                        known.add(key)
                        p = prefix(s, hot.value, percent)
                        shingles.append(p)
                        keys.append(np.full(len(p), key, np.uint64))
                        held += len(p)
                if len(known) > 200_000:
                    known.clear()
                if held > 1 << 20:
                    yield flush(shingles, keys)
                    shingles, keys, held = [], [], 0
        if held:
            yield flush(shingles, keys)

    def flush(shingles: list, keys: list) -> pa.RecordBatch:
        s, k = np.concatenate(shingles), np.concatenate(keys)
        rows = list(packed(parts(mix(s), n), s, k))  # posted hashes crowd at 0, so they are mixed again
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "shingles", "keys"])

    return docs.select(F.col("text").cast("string")).mapInArrow(tidy(run), "part int, shingles binary, keys binary")


def shared_postings(posted: DataFrame) -> DataFrame:
    """(shingle, key, df) of posted shingles that two classes or more have."""

    def run(table: pa.Table) -> pa.Table:
        s, k = unpacked(table.column("shingles"), np.uint64), unpacked(table.column("keys"), np.uint64)
        order = np.lexsort((k, s))
        s, k = s[order], k[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])
        s, k = s[new], k[new]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        df = np.diff(np.append(first, len(s)))
        df = np.repeat(df, df)
        keep = df > 1
        return pa.table({"shingle": s[keep].view(np.int64), "key": k[keep].view(np.int64), "df": df[keep]})

    return posted.groupBy("part").applyInArrow(run, "shingle long, key long, df long")


def memberships(shared_: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(hub, key): the groups in which classes meet. sizes: (key, n)."""
    score = shared_.groupBy("key").agg(F.sum("df").alias("score"), F.count(F.lit(1)).alias("posted"))
    # the partner has percent/100 of the size at least, and the margin is the smaller one's
    least = 1 + F.floor(F.ceil(F.col("n") * percent / 100) / MARGIN)
    scored = shared_.join(score.join(sizes, "key").where(F.col("posted") >= least).select("key", "score", F.floor((least - 1) / 2).alias("spare")), "key")
    hub = scored.groupBy("shingle").agg(F.max(F.struct("score", "key"))["key"].alias("hub"), F.count(F.lit(1)).alias("left")).where("left > 1")
    meet = scored.select("shingle", "key", "spare").join(hub, "shingle").groupBy("key", "hub", "spare").agg(F.count(F.lit(1)).alias("c"))
    # the hubs with fewest shared shingles go while all together they can't hold half the margin; as the
    # partner's do likewise, a pair that links keeps a hub in common
    upto = W.partitionBy("key").orderBy("c", "hub").rowsBetween(W.unboundedPreceding, W.currentRow)
    return meet.withColumn("gone", F.sum("c").over(upto)).where("gone > spare").select("hub", "key")


PLACED = "hub long, x int, y int, side int, key long, many long, plain int, members binary, hubs binary"
PLACED_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
PLACED_NAMES = [x.split()[0] for x in PLACED.split(", ")]


def placed_sets(docs: DataFrame, tasks: DataFrame, hot, width: int) -> DataFrame:
    """The set of each text, in the global order, once for each of its tasks (doc_id, many, tasks).

    plain: how many members come before the frequent ones; hubs: all groups that the class is in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(lower(as_bytes(part.column("text"))), width)
                rows, held = [], 0
                for s, many, places in zip(sets, part.column("many").to_pylist(), part.column("tasks").to_pylist()):
                    key, frequent_ = int(np.uint64(set_key(s)).view(np.int64)), is_in(s, hot.value)
                    members = np.concatenate((s[~frequent_], s[frequent_])).tobytes()
                    plain, hubs = len(s) - int(frequent_.sum()), np.unique(np.array([t["hub"] for t in places], np.int64)).tobytes()
                    for t in places:
                        rows.append((t["hub"], t["x"], t["y"], t["side"], key, many, plain, members, hubs))
                        held += len(members) + len(hubs)
                        if held > 8 << 20:
                            yield batch_of(rows, PLACED_TYPES, PLACED_NAMES)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows, PLACED_TYPES, PLACED_NAMES)

    joined = docs.join(tasks, docs.doc_id.eqNullSafe(tasks.t_doc)).select("text", "many", "tasks")
    return joined.mapInArrow(tidy(run), PLACED)


def batch_of(rows: list, types: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def is_in(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


class Meeting:
    """The classes that meet in a task: their sets in the global order, sides, sizes and groups."""

    def __init__(self, hub: int):
        self.hub = hub
        self.keys: list[int] = []
        self.sets: list[np.ndarray] = []
        self.plain: list[int] = []
        self.sides: list[int] = []
        self.many: list[int] = []
        self.hubs: list[np.ndarray] = []
        self.known: set[int] = set()

    def add(self, key: int, side: int, many: int, plain: int, members: bytes, hubs: bytes) -> None:
        if key not in self.known:  # rows that repeat a doc_id
            self.known.add(key)
            self.keys.append(key)
            self.sides.append(side)
            self.many.append(many)
            self.plain.append(plain)
            self.sets.append(np.frombuffer(members, np.uint64))
            self.hubs.append(np.frombuffer(hubs, np.int64))

    def fragment(self, f: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The members in fragment `f` of `n` of the global order, and whose they are. Frequent ones are the last fragment."""
        lo, hi = f * 2**64 // max(n - 1, 1), (f + 1) * 2**64 // max(n - 1, 1)
        out = []
        for s, plain in zip(self.sets, self.plain):
            if n == 1:
                out.append(s)
            elif f == n - 1:
                out.append(s[plain:])
            else:
                a = np.searchsorted(s[:plain], np.uint64(lo))
                b = plain if hi == 2**64 else np.searchsorted(s[:plain], np.uint64(hi))
                out.append(s[a:b])
        return np.concatenate(out), np.repeat(np.arange(len(out)), [len(x) for x in out])

    def links(self, percent: int, fragments: int) -> np.ndarray:
        """Which classes link; with both sides present, only links across."""
        m = len(self.sets)
        counted = np.zeros((m, m), np.int64)
        for f in range(fragments):
            counted += partial_counts(*self.fragment(f, fragments), m)
        size = np.array([len(s) for s in self.sets], np.int64)
        # 100 overlap >= percent union, with the union as the sizes less the overlap
        link = ((100 + percent) * counted >= percent * (size[:, None] + size[None])) & (counted > 0)
        np.fill_diagonal(link, False)
        sides = np.array(self.sides)
        if len(set(self.sides)) > 1:
            link &= sides[:, None] != sides[None]
        return link

    def own(self) -> np.ndarray:
        """Which pairs count here: those without a smaller hub in common."""
        m = len(self.sets)
        of = np.repeat(np.arange(m), [len(h) for h in self.hubs])
        hubs = np.concatenate(self.hubs)
        of, hubs = of[hubs < self.hub], hubs[hubs < self.hub]
        order = np.argsort(hubs, kind="stable")
        of, hubs = of[order], hubs[order]
        out = np.ones((m, m), bool)
        for o in np.split(of, np.flatnonzero(np.diff(hubs)) + 1):
            if len(o) > 1:
                out[np.ix_(o, o)] = False
        return out


def partial_counts(members: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """How many of the members each two owners have in common."""
    out = np.zeros((m, m), np.int64)
    if not len(members):
        return out
    order = np.argsort(members, kind="stable")
    members, owner = members[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], members[1:] != members[:-1])))
    # equal lists of owners are counted once with their number
    if m <= 63:
        lists, times = np.unique(np.bitwise_or.reduceat(np.int64(1) << owner, first), return_counts=True)
        has = lists[:, None] >> np.arange(m) & 1
        return (has * times[:, None]).T @ has
    stop = np.append(first[1:], len(members))
    found: dict[bytes, int] = {}
    for a, b in zip(first.tolist(), stop.tolist()):
        if b - a > 1:
            x = owner[a:b].tobytes()
            found[x] = found.get(x, 0) + 1
    for x, n in found.items():
        o = np.frombuffer(x, owner.dtype)
        if len(o) * 8 > m:
            mark = np.zeros(m, np.int64)
            mark[o] = n
            out[o] += mark
        else:
            out[np.ix_(o, o)] += n
    return out


def forest(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what `link` connects."""
    edges: list[tuple[int, int]] = []
    todo = link.any(1)
    for i in range(len(link)):
        if todo[i]:
            todo[i], front = False, [i]
            while front:
                j = front.pop()
                near = np.flatnonzero(link[j] & todo)
                todo[near] = False
                front += near.tolist()
                edges += [(j, k) for k in near.tolist()]
    return edges


def block_links(placed: DataFrame, percent: int, fragments: int) -> DataFrame:
    """Of each task: links (a, b, null) that connect its classes, and (class, null, number of rows that it links with)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, here, rows = None, None, []

        def done() -> None:
            if here is None or len(here.keys) < 2:
                return
            link = here.links(percent, fragments)
            if not link.any():
                return
            rows.extend((here.keys[i], here.keys[j], None) for i, j in forest(link))
            n = (link & here.own()) @ np.array(here.many, np.int64)
            rows.extend((here.keys[i], None, int(n[i])) for i in np.flatnonzero(n).tolist())

        for batch in batches:
            for hub, x, y, side, key, many, plain, members, hubs in zip(*(c.to_pylist() for c in batch.columns)):
                if (hub, x, y) != at:
                    done()
                    at, here = (hub, x, y), Meeting(hub)
                here.add(key, side, many, plain, members, hubs)
            if rows:
                yield batch_of(rows, (pa.int64(),) * 3, ["a", "b", "n"])
                rows = []
        done()
        if rows:
            yield batch_of(rows, (pa.int64(),) * 3, ["a", "b", "n"])

    sorted_ = placed.repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y")
    return sorted_.mapInArrow(tidy(run), "a long, b long, n long")


def with_class_key(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of `docs` in all their columns, and the `class_key` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys = np.array([set_key(s) for s in shingle_sets(lower(as_bytes(part.column("text"))), width)], np.uint64)
                yield part.append_column("class_key", pa.array(keys.view(np.int64)))

    return docs.mapInArrow(tidy(run), StructType([*docs.schema, StructField("class_key", LongType())]))


def rooted(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, fragments: int = FRAGMENTS) -> DataFrame:
    """`doc_id, n, key, root, n_links` of each row: size and key of its set (0 if empty), the key that its component
    is known by, and the number of other rows that it links with."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with_keys, counts = documents_with_keys(docs, width)
    hot = spark.sparkContext.broadcast(frequent(counts))
    posted = postings(docs, hot, width, percent, n_parts(spark))
    # one row of each class stands for it
    reps = with_keys.where("key <> 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("many"))
    reps = cut(reps)
    met = cut(memberships(cut(shared_postings(posted)), reps.select("key", "n"), percent))
    # blocks of a group are so many that each holds BLOCK_BYTES or so
    weight = met.join(reps, "key")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.sum(F.col("n") * 8 + 200) / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("int")
    blocks = weight.groupBy("hub").agg(n_blocks.alias("blocks"))
    placed = weight.join(blocks, "hub").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    tasks = placed.select("hub", "doc_id", "many", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    # in a task of two blocks, side 0 is block x; a task of one block has side 0 alone
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    task = F.struct("hub", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side)
    tasks = cut(tasks.groupBy(F.col("doc_id").alias("t_doc")).agg(F.collect_list(task).alias("tasks"), F.max("many").alias("many")))
    if (many := tasks.count()) <= SENT_IDS:
        docs_met = docs.join(F.broadcast(tasks.select("t_doc").where("t_doc is not null")), F.col("doc_id") == F.col("t_doc"), "left_semi")
        docs_met = docs_met if many == tasks.where("t_doc is not null").count() else docs_met.unionByName(docs.where("doc_id is null"))
    else:
        docs_met = docs
    found = written(block_links(placed_sets(docs_met, tasks, hot, width), percent, fragments), "links")
    roots = components(found.where("b is not null").select("a", "b"))
    linked = found.where("b is null").groupBy(F.col("a").alias("l_key")).agg(F.sum("n").alias("others"))
    known = reps.select(F.col("key").alias("r_key"), "many").join(linked, F.col("r_key") == F.col("l_key"), "left")
    known = known.join(roots, F.col("r_key") == F.col("node"), "left")
    # a table of its own, so that hot classes can be split in the join of their rows
    known = cut(known.select("r_key", F.coalesce("root", "r_key").alias("root"), (F.col("many") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    out = with_keys.join(known, F.col("key") == F.col("r_key"), "left")
    return out.select("doc_id", "n", "key", F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, fragments: int = FRAGMENTS) -> DataFrame:
    """`doc_id, n_shingles, component_id, class_key, n_links` of each row."""
    named = rooted(docs, percent, width, fragments)
    # a table of its own, so that the join's hot roots can be split
    names = cut(named.where("key <> 0").groupBy(F.col("root").alias("r_root")).agg(F.min("doc_id").alias("least")))
    out = named.join(names, (named.root == names.r_root) & (named.key != 0), "left")
    component = F.when(F.col("key") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").alias("class_key"), "n_links")

"""Every operator and pipeline stage on nulls, empties, a long text, ties, repeats, an empty table and clashing names."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("dossia.llm")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from dossia.llm import chat, decontaminate, jaccard, licenses, packing, quality, shards, suffixes, tokens, warc  # noqa: E402

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
#: Names that operators use themselves.
CLASH = ["row", "spans", "copies", "own", "digest", "spans_", "copies_", "own_digest_", "digest_", "quality", "l_id", "d_id", "d_text", "k_id", "k_key", "m_id", "key", "root", "class_key", "tasks", "hub", "n", "size", "p", "ids", "base", "place", "bucket", "fraction", "item_id", "kept"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def long_text():
    rng = random.Random(3)
    return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(130_000))


def rows():
    prose = " ".join(f"word{k}" for k in range(90)) + "."
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, prose), (4, prose), (5, prose), (None, prose), (None, None), (6, "a b c"), (7, "A B C"), (8, prose + " end"), (9, long_text()), (10, "\x00\x1f é漢😀 " * 5)]
    return [(i, t, None, None if k % 3 == 0 else "s", None, *("x" for _ in CLASH)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "word3 word4 word5 word6 word7 word8"), (None, None), (2, ""), (1, "word3 word4 word5 word6 word7 word8")], "item_id long, text string")


@pytest.fixture(scope="module")
def field(spark, docs):
    return quality.train(docs, spark.createDataFrame([(4, 1, 0), (9, 0, 0), (None, 1, 0), (10, None, 0)], "doc_id long, quality int, toxic int"))


N = len(rows())


def test_one_row_each(docs, none, field):
    """Operators that give a row for each document."""
    for f in (jaccard.jaccard_components, suffixes.digest, licenses.scan_licenses, shards.interleaved_shards, lambda d: tokens.token_counts(d, BYTE), lambda d: quality.judged(d, field)):
        assert f(docs).count() == N and f(none).count() == 0
        ids = sorted(str(r[0]) for r in f(docs).select("doc_id").collect())
        assert ids == sorted(str(r[0]) for r in rows())


def test_defined_results(docs, field, bench):
    sets = {(r.doc_id, r.n_shingles): (r.component_id, r.n_links) for r in jaccard.jaccard_components(docs).collect()}
    assert sets[1, 0] == (1, 0) and sets[None, 0] == (None, 0) and sets[4, 86] == (4, 4) and sets[6, 1] == (6, 1) and sets[7, 1] == (6, 1) and sets[8, 87] == (4, 4)
    gone = defaultdict(list)
    for r in suffixes.digest(docs).collect():
        gone[r.doc_id].append((r.n_bytes, r.n_removed))
    size = len(rows()[3][1])
    assert gone[4] == [(size, size)] * 2 and gone[5] == [(size, size)] and gone[1] == [(0, 0)] and gone[9][0][1] == 0
    assert {r.doc_id for r in quality.judged(docs, field).where("base_failed").collect()} >= {1, 2, 3, 6, 7}
    assert Counter(r.doc_id for r in decontaminate.contaminated(docs, bench).collect()) == Counter({4: 4, 5: 2, None: 2, 8: 2})


def test_keep_columns(docs, none, field, bench):
    """Operators that give documents in all their columns, whatever these are called."""
    spark = docs.sparkSession
    for f in (suffixes.deduplicated, lambda d: quality.judged(d, field, keep_columns=True), lambda d: decontaminate.clean(d, bench), lambda d: jaccard.with_class_key(d.drop("class_key")).drop("class_key").withColumn("class_key", F.lit("x"))):
        out = f(docs)
        assert sorted(out.columns) == sorted(docs.columns) and f(none).count() == 0
        assert all(r[c] == "x" for r in out.collect() for c in CLASH)
    del spark


def test_stages(docs, none, bench, tmp_path):
    spark = docs.sparkSession
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(4, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = {"n-gram Jaccard join": [1, 2, 3, 4, 6, 9, 10, None], "benchmark decontamination": [1, 2, 3, 6, 7, 9, 10, None], "suffix-array dedup": [6, 7, 8, 9, 10]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        if name in want:
            # words and null texts: documents that hold nothing are kept by the join and go with the passages
            kept = Counter(r.doc_id for r in out.select("doc_id").collect())
            assert set(kept) == set(want[name]), name
        assert stage(spark, none, str(tmp_path)).count() == 0
        assert stage(spark, docs.drop(*CLASH, "n_chars", "lang"), str(tmp_path)).count() == out.count()


def test_null_repeats_are_kept_once(spark):
    prose = [" ".join(f"{c}{k}" for k in range(60)) for c in "ab"]
    own = spark.createDataFrame([(1, prose[0]), (3, prose[0]), (3, prose[1]), (1, prose[0])], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_duplicates(spark, own, "").collect())) == [(1, prose[0]), (3, prose[1])]


def packed_plainly(pieces, texts):
    """Checks pieces against the library: every id once, in order, with its check sum; full sequences but at powers of two."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    own = defaultdict(list)
    for p in pieces:
        own[p.doc_id, p.doc_tokens].append(p)
    left = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        left[i, len(ids)] += 1
        at = sorted(own[i, len(ids)], key=lambda p: p.start)
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        for p in at:
            assert p.ids_crc32 == zlib.crc32(raw[4 * p.start : 4 * (p.start + p.length)])
    for (i, n), many in left.items():
        covered = Counter(k for p in own[i, n] for k in range(p.start, p.start + p.length))
        assert set(covered) == set(range(n)) and set(covered.values()) == {many}
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    sizes = []
    for own_ in by_sequence.values():
        at = 0
        for offset, length in sorted(own_):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(s & (s - 1) == 0 and s <= 4096 for s in sizes)
    return sizes


def test_packing_against_plain(spark, docs, none):
    rng = random.Random(12)
    texts = [(i, t) for i, t, *_ in rows() if i not in (None, 4)] + [(100 + k, " ".join(f"t{rng.randint(0, 999)}" for _ in range(rng.choice((3, 60, 700, 3000))))) for k in range(60)]
    own = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    out = packing.pack(own, WORD)
    pieces = out.collect()
    sizes = packed_plainly(pieces, texts)
    small = [s for s in sizes if s < packing.SMALLEST]
    assert len(small) <= 8 and sum(sizes) == sum(p.length for p in pieces)
    steps = Counter(p.step for p in pieces if p.tier == 4096 and p.sequence_id < 0)
    assert max(steps.values()) - min(steps.values()) <= 1 + max(steps.values()) // 2
    again = packing.pack(own, WORD)
    assert again.coalesce(1).count() == len(pieces) and again.unionByName(again).count() == 2 * len(pieces)
    assert packing.pack(none, WORD).count() == 0 and packing.pack(docs, WORD).select("doc_id").distinct().count() == len({r[0] for r in rows()})


def test_shards_against_plain(docs):
    """Ranks and cuts by sorting everything in one place."""
    n = 5
    own = []
    for i, t, _, source, *_ in rows():
        raw = (t or "").encode()
        digest = hashlib.md5(f"7|{'' if i is None else i}|{hashlib.md5(raw).hexdigest()}".encode()).hexdigest()
        own.append((source, digest, -1 if i is None else i, zlib.crc32(raw), len(raw) + 8))
    of = Counter(r[0] for r in own)
    order = []
    for source in of:
        for k, r in enumerate(sorted((r for r in own if r[0] == source), key=lambda r: r[1:4])):
            order.append(((2 * k + 1) * 2**40 // (2 * of[source]), r[1], source or "", r[2], r[3], r[4]))
    order.sort()
    want = []
    for k, r in enumerate(order):
        shard = k * n // len(order)
        want.append((r[3], r[5], r[4], shard, k - -(-shard * len(order) // n)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in shards.interleaved_shards(docs, n).collect()]
    assert sorted(got) == sorted(want)


def test_warc_edges(spark):
    big = "é" * 40_000
    rows_ = [(None, None, None), (None, "u", ""), (1, "a\r\nb", big), (2, None, big), (2, None, big), (3, "x", "WARC/1.1\r\n\r\n\r\n"), (4, "y", "z" * 5_000_000)]
    got = warc.warc_round_trip(spark.createDataFrame(rows_, "page_id long, url string, html string").withColumn("address", F.lit("x")))
    found = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect())
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(None, 0, sha(""), "response", None)] * 2 + [(1, 80_000, sha(big), "revisit", 2), (2, 80_000, sha(big), "revisit", 2), (2, 80_000, sha(big), "response", None), (3, 14, sha(rows_[5][2]), "response", None), (4, 5_000_000, sha(rows_[6][2]), "response", None)]
    assert found == Counter(want) and not spark.catalog.listTables()


def test_warc_salts(spark, monkeypatch):
    monkeypatch.setattr(warc, "SALTED", 7)
    rows_ = [(k, f"u{k}", "" if k % 3 else "b" * 2000) for k in range(90)]
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_round_trip(spark.createDataFrame(rows_, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == {k: (0, "response", None) if k % 3 else (2000, "response", None) if k == 87 else (2000, "revisit", 87) for k in range(90)}


def test_warc_of_others():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:x\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [(f["warc-payload-digest"], block) for f, _, block in warc.records_of(record * 2)] == [("sha1:x", b"ab")] * 2


def test_chat_edges(spark):
    part = "struct<type:string,text:string,ref:string,tokens:int>"
    text = lambda t: [("text", t, None, None)]
    odd = ["a\x00\x01b", "a\\nb\nc\\", "<|im_end|>", "<\\\\|x", "\\s\\n", ""]
    rows_ = [(k, 0, role, text(role)) for k, role in enumerate(odd)] + [(50, 1, "assistant", text("x")), (50, 1, "assistant", text("x")), (50, None, "user", text("q")), (None, 1, None, text(None)), (60, 0, "assistant", [("audio", None, "a.wav", 2), ("document", None, "d.pdf", None), ("text", "t" * 10**6, None, None)])]
    out = chat.format_chat(spark.createDataFrame(rows_, f"conv_id long, turn long, role string, parts array<{part}>").withColumn("pieces", F.lit("x")))
    back = {r.conv_id: r for r in chat.read_chat(out).collect()}
    for k, role in enumerate(odd):
        assert [(t.role, t.text) for t in back[k].turns] == [(role, role)]
    assert [(t.role, t.text) for t in back[50].turns] == [("user", "q"), ("assistant", "x"), ("assistant", "x")] and back[50].loss_text == "xx"
    assert [(t.role, t.text) for t in back[None].turns] == [("", "")]
    assert [(a.type, a.tokens) for a in out.where("conv_id = 60").first().attachments] == [("audio", 2), ("document", 1)] and len(back[60].loss_text) > 10**6
    digest = chat.chat_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in digest] == [(-1, 2, 34)]


def test_held_out_quality(spark):
    """Half of the labels train; of the other half, at least 95 in 100 are judged as labelled."""
    folder = "/root/testdata/sf0.01"
    docs_, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    known = labels.where("quality is not null")
    field_ = quality.train(docs_, known.where("xxhash64(doc_id) % 2 = 0"))
    got = quality.judged(docs_, field_).join(known.where("xxhash64(doc_id) % 2 <> 0"), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) >= 0.95 * len(got) > 0
    assert any(0.01 < r.content_share < 0.99 for r in got)


def test_pipeline_against_plain(spark, tmp_path):
    """run() on a small corpus against each stage done plainly (without labels, quality is the base rules)."""
    from tokenizers import Tokenizer

    from test_llm import linked_plainly
    from test_whole import share

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 7)))
    item = [word() for _ in range(20)]
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randint(80, 150))) for _ in range(30)]
    texts += [texts[0], texts[1] + " more", " ".join(texts[2].split()[:-1]), texts[3].upper()]
    texts += [" ".join(texts[4].split()[:70]) + " " + passage + " " + word(), word() + " " + passage + " " + texts[5]]
    around = lambda: " ".join(word() for _ in range(40))
    texts += [around() + " " + " ".join(item) + " " + word(), around() + " " + " ".join(w if k % 5 else word() for k, w in enumerate(item)) + " " + around()]
    texts += ["too short", "a b c d e " * 20, None, ""]
    docs_ = [(k, t) for k, t in enumerate(texts)]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs_], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = Counter()
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[p.doc_id] += p.length

    def fine(t):
        w = (t or "").split()
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        twice = {k + x for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for x in range(5)}
        return len(w) >= 10 and 100 * len(twice) <= 20 * len(w)

    kept = [(k, t) for k, t in docs_ if fine(t)]
    roots = {i for i, _, root, _ in linked_plainly(kept) if i == root}
    kept = [(k, t) for k, t in kept if k in roots]
    width, seen = corpus_pipeline.PASSAGE_BYTES, Counter()
    for _, t in kept:
        raw = t.encode()
        seen.update(raw[k : k + width] for k in range(len(raw) - width + 1))
    cut = []
    for k, t in kept:
        raw = t.encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - width + 1):
            if seen[raw[a : a + width]] > 1:
                gone[a : a + width] = b"\x01" * width
        out, a = b"", 0
        while a < len(raw):
            b = a
            while b < len(raw) and gone[b] == gone[a]:
                b += 1
            if not gone[a] or len(raw[a:b].split()) < corpus_pipeline.PASSAGE_WORDS:
                out += raw[a:b]
            a = b
        if out.strip():
            cut.append((k, out.decode()))
    clean = [(k, t) for k, t in cut if share(item, t.lower().split())[0] < 0.6]
    library = Tokenizer.from_file(WORD)
    assert got == Counter({k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in clean})
    assert len(clean) < len(cut) < len(docs_) and any(t != texts[k] for k, t in clean)


def test_tokens_of_bytes():
    """The merger on random byte strings, against the library."""
    from tokenizers import Tokenizer

    library, counter, rng = Tokenizer.from_file(BYTE), tokens.Counter(BYTE), random.Random(2)
    special = json.load(open(BYTE, encoding="utf-8"))["added_tokens"]
    texts = ["".join(rng.choice(["a", "the ", "é", "漢", "\n", "  ", "1", "'s", "!!", "\x00", special[0]["content"]]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("dossia.llm")
from dossia.llm import chat, decontaminate, jaccard, licenses, packing, quality, shards, suffixes, tokens, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket int, place int, key int"
BYTE, WORD = (__import__("public_tokenizers").path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    base = [word() for _ in range(300)]
    texts = [None, "", "  \n ", "one two", "One  TWO", "a b c d e", " ".join(base), " ".join(base), "x " + " ".join(base[100:250]), " ".join(base[:40] * 30)]
    for k in range(40):
        w = base[:150] if k % 2 else [word() for _ in range(150)]
        w = [word() if rng.random() < 0.03 else x for x in w]
        texts.append(" ".join(w))
    texts.append(" ".join(word() for _ in range(20000)))
    return [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", 1, 1, 1, 1) for i, t in enumerate(texts)] + [(3, "one two", "en", "s0", 1, 1, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def linked_plainly(rows):
    """(doc_id, size of its set, component, number of links) of each row, by all pairs."""
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[find(i)], links[i]) for i, r in enumerate(rows))


def linked_here(docs, **more):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_components(docs, **more).collect())


def test_jaccard(docs, empty):
    assert linked_here(docs) == linked_plainly(corpus())
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_hot_group(spark, monkeypatch):
    """A group of near copies over many blocks and a chain of them, with any number of fragments."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(f"x{rng.random()}" if rng.random() < 0.012 else w for w in base)) for i in range(260)]
    chain = [f"c{k}" for k in range(400)]
    rows += [(300 + k, " ".join(chain[8 * k : 8 * k + 100])) for k in range(30)]
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 50)
    monkeypatch.setattr(jaccard, "HOT_LEAST", 4)
    own, want = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), linked_plainly(rows)
    for fragments in (1, 4, 16):
        assert linked_here(own, fragments=fragments) == want


def test_suffixes(docs, empty):
    rows = corpus()
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[k : k + 400] for t in raw for k in range(len(t) - 399))
    want = []
    for r, t in zip(rows, raw):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want.append((r[0], len(t), int(gone.sum()), int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()))
    assert sorted(tuple(r)[:5] for r in suffixes.digest(docs).collect()) == sorted(want)
    assert suffixes.digest(empty).count() == 0
    assert suffixes.deduplicated(docs).columns == docs.columns


def test_passages_below_the_width(docs):
    """Passages of over 50 words that repeat across documents are told, those of under 400 bytes too, and what goes stays as it was."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 6)))
    planted = [" ".join(word() for _ in range(55)) for _ in range(6)]
    assert all(len(p) < 400 for p in planted)
    rows = [(100 + k, " ".join([*(word() for _ in range(80)), planted[k % 6] if k < 18 else word(), *(word() for _ in range(80))])) for k in range(36)]
    # of one occurrence, and repeated with few words
    rows += [(200, " ".join(word() for _ in range(400))), (201, "x" * 300 + " a"), (202, "b " + "x" * 300), (203, planted[0]), (204, planted[0]), (205, "é" * 150 + " " + " ".join(word() for _ in range(20)))]
    rows += [(i, t) for i, t, *_ in corpus()]
    own = docs.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3)
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + 200] for t in raw for k in range(len(t) - 199))
    want = []
    for (i, _), t in zip(rows, raw):
        gone = np.zeros(len(t) + 2, np.int8)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k + 1 : k + 201] = 1
        edges = np.flatnonzero(np.diff(gone)).reshape(-1, 2).tolist()
        sizes = [b - a for a, b in edges if len(t[a:b].split()) >= 50]
        want.append((i, len(sizes), sum(sizes)))
    got = suffixes.digest(own).collect()
    assert sorted((r.doc_id, r.n_passages, r.passage_bytes) for r in got) == sorted(want)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[100 + k].n_passages == (k < 18) and by_id[100 + k].n_removed == 0 for k in range(36))
    assert by_id[203].n_passages == 1 and by_id[201].n_passages == 0 and by_id[200].n_passages == 0


def test_induced_order():
    rng = random.Random(1)
    for width in (4, 8, 20):
        for alphabet in (b"a", b"ab", bytes(range(256))):
            base = bytes(rng.choice(alphabet) for _ in range(60))
            texts = [bytes(rng.choice(alphabet) for _ in range(9)) + base[k : k + 30] for k in range(0, 30, 5)]
            seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
            for t, got in zip(texts, suffixes.repeated_windows(texts, width)):
                assert got.tolist() == [seen[t[i : i + width]] > 1 for i in range(len(t) - width + 1)]


def test_tokens_and_packing(docs, empty):
    from tokenizers import Tokenizer

    rows = corpus() + [(99, "a<|endoftext|>b  \n\x1f Éé!!", "en", "s", 1, 1, 1, 1)]
    docs = docs.sparkSession.createDataFrame(rows, DOCS)
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    want = sorted((r[0], len(byte.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((r.doc_id, r.n_tokens) for r in tokens.token_counts(docs, BYTE).collect()) == want
    pieces = packing.pack(docs, WORD, extra_ids=True).collect()
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and sum(p.length for p in own) <= 4096
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == Counter({k: v for k, v in ((i, sum(len(word.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows if r[0] == i)) for i in {r[0] for r in rows})})
    assert packing.pack(empty, WORD).count() == 0 and tokens.token_counts(empty, BYTE).count() == 0


def test_word_memory(monkeypatch):
    """A memory far smaller than the texts' words forgets, but gives the library's ids."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "LINE", 7)
    library = Tokenizer.from_file(WORD)
    monkeypatch.setattr(packing, "_ids", {WORD: (packing.WordIds(library, 40, True), packing.WordIds(library, 10, False))})
    texts = [(t or "") + end for _, t, *_ in corpus()[:40] for end in ("", " it's 'sup ''s don't 12,5!?", " \u0130\u4f60\u597d e\u0301 <|endoftext|> ok")]
    for lo in range(0, len(texts), 10):
        some = texts[lo : lo + 10]
        got, kind = packing.token_ids(WORD, [t.encode() for t in some], 2)
        assert [np.frombuffer(x, kind).tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids + [2] for t in some]


def test_quality(spark, docs, empty):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) + "."
    bad = lambda: " ".join("".join(rng.choice("ABCDEFGH") for _ in range(5)) + "!!" for _ in range(60))
    rows = [(i, good() if i % 2 else bad(), "en", "s", 1, 1, 1, 1) for i in range(200)]
    own = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    field = quality.train(own, labels)
    got = {r.doc_id: r.kept for r in quality.judged(own, field).collect()}
    assert np.mean([got[i] == (i % 2 == 1) for i in range(100, 200)]) > 0.95  # held out
    nothing = quality.train(own, labels.where("quality = 1"))
    assert quality.judged(docs, nothing).count() == len(corpus()) and quality.judged(empty, nothing).count() == 0
    assert quality.judged(docs, nothing, keep_columns=True).columns == docs.columns


def test_shards(docs, empty):
    got = shards.interleaved_shards(docs, 4).collect()
    n = Counter(r.shard for r in got)
    assert len(got) == len(corpus()) and max(n.values()) - min(n.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(k)) for s, k in n.items())
    for source in {r.source for r in got}:
        mix = Counter(r.shard for r in got if r.source == source)
        assert max(mix[s] for s in n) - min(mix[s] for s in n) <= 2
    assert shards.interleaved_shards(empty).count() == 0


def test_chat(spark):
    part = "struct<type:string,text:string,ref:string,tokens:int>"
    rows = [(1, 0, "user", [("text", "see <|im_end|> <\\|x", None, None), ("image", None, "a.png", 3)]), (1, 1, "assistant", [("text", "ok\n", None, None)]), (2, None, None, [])]
    out = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>"))
    one = out.where("conv_id = 1").first()
    assert one.formatted.count("<|image|>") == 3 and [(a.type, a.ref, a.tokens) for a in one.attachments] == [("image", "a.png", 3)]
    back = {r.conv_id: r for r in chat.read_chat(out).collect()}
    assert back[1].turns[0].role == "user" and back[1].turns[0].text.startswith("see <|im_end|> <\\|x") and back[1].loss_text == "ok\n"
    assert [(t.role, t.text) for t in back[2].turns] == [("", "")]


def test_warc(spark):
    big = "x" * 1500
    rows = [(1, "u1", big), (2, "u2\r\n", big), (3, "u3", None), (4, "u4", "a\r\n\r\nb"), (5, "u5", "a\r\n\r\nb"), (2, "u2\r\n", big)]
    got = sorted(map(tuple, warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert (1, 1500, sha(big), "revisit", 2) in got and sum(g[3] == "response" for g in got if g[1] == 1500) == 1
    assert (3, 0, sha(""), "response", None) in got and (4, 6, sha("a\r\n\r\nb"), "response", None) in got and len(got) == 6
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_licenses(spark):
    rows = [(1, "Prose here.\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0."), (2, None), (3, "no licence")]
    got = {r.doc_id: (r.licenses, r.n_unmatched) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT,Apache-2.0", 0), 2: ("", 0), 3: ("", 0)}


def test_decontaminate(spark, docs, empty):
    item = "The quick brown fox jumps over the lazy dog while seven wizards mix strange green potions at night"
    edited = item.replace("brown", "red").replace("seven", "eight").upper()
    rows = [(1, "intro words " + item + " outro"), (2, "before " + edited + " after"), (3, "nothing of the kind is here at all"), (4, None), (5, item)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (8, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(own, bench).collect()) == [(1, 9), (2, 9), (5, 9)]
    assert sorted(r.doc_id for r in decontaminate.clean(own, bench).collect()) == [3, 4]
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(own, bench.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0

"""Filter interactions, periodic runs and personal data against plain versions, and their edge cases; archives of others; decoding."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations, product
from math import exp, log

import numpy as np
import pytest

pytest.importorskip("dossia.llm")
from pyspark.sql import functions as F  # noqa: E402

from dossia.llm import interactions, licenses, periods, pii, quality, warc  # noqa: E402

CLASH = ["row", "part", "mask", "digest", "id", "n", "salt", "edge", "first", "least", "found", "base", "spans", "runs", "collapsed", "ws", "h", "a", "p", "g", "x", "kind"]
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASH)


def frame(spark, rows):
    """Documents of (doc_id, text, lang), with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, l, *("x" for _ in CLASH)) for i, t, l in rows], SCHEMA)


# filter interactions


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
    return {k for k, v in out.items() if v}


def audited_plainly(rows, labels):
    """Every document walked through every order."""
    least, good, toxic = {}, set(), set()
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    out, value = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for i, t, l in rows:
            bad = fails(t or "") | ({"E"} if i is not None and i > least[t or ""] else set())
            gone = False
            for s, f in enumerate(order, 1):
                c = out.setdefault((l or "", order, s), Counter())
                c["unique"] += bad == {f}
                if f in bad:
                    c["redundant" if gone else "removed"] += 1
                    c["good"] += not gone and i in good
                    c["toxic"] += not gone and i in toxic
                    value[l or "", f] += not gone
                    gone = True
                c["kept"] += not gone
    return sorted((p, o, s, c["kept"], c["removed"], c["redundant"], c["unique"], c["good"], c["toxic"], value[p, o[s - 1]]) for (p, o, s), c in out.items())


def audit_rows():
    rng = random.Random(7)
    texts = [None, "", " \n ", "SHOUT " * 120, " ".join(f"w{k}" for k in range(150)), " ".join(f"w{k}" for k in range(150)) + " $", "a b " * 60, "漢 É😀 A", "x" * 50_000]
    rows = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(60)]
    # a text's smallest id twice, a row without id, and copies in another part
    return rows + [(0, texts[4], "en"), (0, texts[4], "en"), (0, texts[4], "de"), (None, texts[4], "en"), (None, texts[4], "en"), (5, texts[4], None)]


def test_interactions(spark):
    rows, labels = audit_rows(), [(k, k % 2, int(k % 3 == 0)) for k in range(0, 50, 2)] + [(2, 1, None), (2, 0, 1), (None, 1, 1), (9999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = interactions.interaction_audit(frame(spark, rows), marks)
    assert sorted(tuple(r) for r in got.collect()) == audited_plainly(rows, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert interactions.interaction_audit(frame(spark, []), marks).count() == 0
    assert interactions.interaction_audit(frame(spark, rows), marks.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_lattice():
    assert len(interactions.edges(list("ABCDE"))) == 80 and len(interactions.paths(list("ABCDE"))) == 600
    # each filter's edges are on all 120 orders once
    for bit in (1, 2, 4, 8, 16):
        assert sum(n for _, b, n in interactions.edges(list("ABCDE")) if b == bit) == 120


def test_other_filters(spark):
    """Conditions of a caller's own, with copies as the last filter."""
    rows = [(1, "aa", "en"), (2, "aa", "en"), (3, "b", "en")]
    got = interactions.interaction_audit(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"), {"L": F.length("text") > 1})
    assert sorted((r.filter_order, r.step, r.kept, r.removed, r.redundant) for r in got.collect()) == [("EL", 1, 2, 1, 0), ("EL", 2, 1, 1, 1), ("LE", 1, 1, 2, 0), ("LE", 2, 1, 0, 1)]
    with pytest.raises(ValueError):
        interactions.interaction_audit(frame(spark, rows), frame(spark, rows), {c: F.lit(True) for c in "abcdefgh"})


# periodic runs


def runs_plainly(words, least=6, times=4):
    best = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, times * q):
                best.setdefault((start, i + q - start), q)  # smaller periods come first
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng, n, letters):
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        s, p = rng.randrange(n), rng.randint(1, 7)
        for i in range(s, min(n, s + rng.randint(4, 50))):
            words[i] = words[s + (i - s) % p]
    return words


def test_runs_of():
    rng = random.Random(1)
    for _ in range(1500):
        words = repetitive(rng, rng.randint(1, 70), rng.choice([1, 2, 3, 8]))
        want = runs_plainly(words)
        assert periods.runs_of(words) == want
        text = " ".join(map(str, words)).encode()
        assert [(a + s, n, p) for a, b in periods.stretches([b"", text, text])[2] for s, n, p in periods.runs_of(periods.numbered(text.split()[a:b]))] == want


def test_runs_survive_bad_hashes(monkeypatch):
    """Hashes that agree on too much: words decide."""
    monkeypatch.setattr(periods, "_BASE", 2**63)
    rng = random.Random(2)
    for _ in range(300):
        words = repetitive(rng, rng.randint(1, 70), 2)
        assert periods.runs_of(words) == runs_plainly(words)


def test_long_runs_are_linear():
    """One run over a long text, and many that overlap little, end in seconds."""
    assert periods.runs_of([1] * 300_000) == [(0, 300_000, 1)]
    assert periods.runs_of([k % 7919 for k in range(200_000)]) == [(0, 200_000, 7919)]


def planted_plainly(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if i is None or not n or zlib.crc32(str(i).encode()) % 10:
        return words
    g = zlib.crc32(str(i).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def digest_plainly(i, text):
    words = planted_plainly(i, text)
    runs = runs_plainly(words)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_periodic_runs(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a", "a a a a a a", "b a a a a a", "é 漢 😀 " * 9, "A a " * 12, "a a " * 8, "\x1fa \x1fa " * 8]
    texts += [" ".join(map(str, repetitive(rng, rng.randint(1, 150), rng.choice([2, 5, 60])))) for _ in range(150)]
    rows = [(k, t, None) for k, t in enumerate(texts)] + [(None, "c d " * 9, None), (4, "a a a a a a", None), (10**12, " ".join(f"w{rng.randrange(10**6)}" for _ in range(2500)), None)]
    docs = frame(spark, rows)
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in periods.digest(periods.periodic_runs(periods.with_planted_periods(docs))).collect()), key=key)
    assert got == sorted((digest_plainly(i, t) for i, t, _ in rows), key=key)
    kept = periods.periodic_runs(docs, keep=docs.columns[:-1])
    assert kept.columns == [*docs.columns[:-1], "runs", "collapsed"] and kept.count() == len(rows)
    assert periods.periodic_runs(frame(spark, [])).count() == 0
    # the operator's own results: spans and text
    own = {r.doc_id: r for r in periods.periodic_runs(docs).collect()}
    assert [tuple(r) for r in own[6].runs] == [(0, 27, 3)] and own[6].collapsed == "é 漢 😀" and own[1].collapsed == ""


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(number))) % 10 == 0


def base_plainly(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            s, d = m.group(0), re.sub("[^0-9]", "", m.group(0))
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in s.split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(spark):
    rng = random.Random(4)
    alphabet = ["a", "Z", "@", ".", " ", "-", "+", "(", ")", "0", "1", "9", "255", "256", "007", "4", "%", "_", "漢", "😀", "\n", "a@b.c", "1.2.3.4", "+1 (555) 555-1234", "4969041296088474", "x"]
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))), None) for k in range(3000)]
    rows += [(-1, "1" * 60_000, None), (-2, "1 " * 60_000, None), (-3, "+1" + "(" * 60_000, None), (-4, "a@b.c%d@e.f", None), (-5, None, None), (None, "x@y.z", None)]
    out = frame(spark, rows).repartition(4).select("doc_id", "text", pii.base_spans(F.coalesce("text", F.lit(""))).alias("spans"))
    for r in out.collect():
        assert [tuple(x) for x in r.spans] == base_plainly(r.text), r.text[:80]
    # texts on which a pattern that goes back on itself would not end
    long = frame(spark, [(1, "a" * 300_000, None), (2, "1.2" * 100_000, None), (3, "a@" * 100_000, None), (4, "7 " * 200_000, None)])
    assert long.select(F.size(pii.base_spans(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0] == 25_000  # dotted quads


def test_places_are_linear(spark):
    """Many matches in one text: places and votes by one pass."""
    text = " ".join(f"user{k}@mail.example.com" for k in range(8000))
    r = pii.personal_data(frame(spark, [(1, text, None)])).first()
    assert len(r.base) == len(r.spans) == 8000 and tuple(r.spans[-1])[1:] == (text.rindex(" ") + 1, len(text))


def private_rows():
    rng = random.Random(5)
    rows, planted, k = [], defaultdict(list), 0
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        head = "4" + number(14)
        return next(head + c for c in "0123456789" if luhn(head + c))

    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    for k in range(600):
        parts = [word() for _ in range(20)]
        if k % 3 == 0:
            values = [(rng.choice(["phone", "card"])) for _ in range(2)]
            made = [f"+1 ({number(3)}) 555-{number(4)}" if v == "phone" else card() for v in values]
            at = rng.randrange(20)
            parts[at:at] = made  # side by side, so that base patterns take both as one
            text = " ".join(parts)
            place = len(" ".join(parts[:at])) + (at > 0)
            for kind, value in zip(values, made):
                planted[k].append((kind, place, place + len(value)))
                place += len(value) + 1
        elif k % 3 == 1:
            text = " ".join(parts) + f" version {number(2)}.{number(1)} of order {number(6)}"
        else:
            text = " ".join(parts) + f" joe.{k}@mail.example.com"
        rows.append((k, text, None))
    return rows, planted


def test_personal_data(spark):
    rows, planted = private_rows()
    docs = frame(spark, [*rows, (None, None, None), (0, rows[0][1], None), (-1, "", None)])
    got = pii.personal_data(docs, keep=["doc_id", "text"])
    seen = 0
    for r in got.collect():
        spans = [tuple(x) for x in r.spans]
        assert [tuple(x) for x in r.base] == base_plainly(r.text)
        assert set(base_plainly(r.text)) <= set(spans) and len(set(spans)) == len(spans)
        order = [(pii.KINDS.index(k), s) for k, s, _ in spans]
        assert order == sorted(order)
        if r.doc_id in planted and r.doc_id >= 0:
            # what isn't found as planted is inside a base span that took more
            seen += all(p in spans or any(b[1] < p[2] and p[1] < b[2] for b in base_plainly(r.text)) for p in planted[r.doc_id])
        if r.doc_id is not None and r.doc_id % 3 == 1:
            assert not spans
    assert seen == len(planted) + 1
    digest = pii.digest(got).where("doc_id = 2").first()
    assert digest.n_email == 1 and digest.base_sha256 == hashlib.sha256(digest.spans.encode()).hexdigest()
    assert pii.personal_data(frame(spark, [])).count() == 0


def test_failed_checks_are_not_added(spark):
    """A number that fails the check of cards is none, whatever the labelers say."""
    rows = [(k, f"pay by visa card 4{k:015d} now", None) for k in range(300)]
    for r in pii.personal_data(frame(spark, rows), keep=["doc_id", "text"]).collect():
        number = r.text.split()[4]
        assert [x.kind for x in r.spans] == (["card"] if luhn(number) else [])


def trained_plainly(found):
    """The same expectation-maximisation and classifier, row by row."""
    patterns = Counter((x.kind, x.votes) for xs in found for x in xs)
    p = {k: 0.0 if k[1][0] == "-" else 1 / (1 + exp(-1.5 * (k[1].count("+") - k[1].count("-")))) for k in patterns}
    for _ in range(pii.ROUNDS):
        sums = defaultdict(lambda: [0.0, 0.0])
        for (kind, votes), n in patterns.items():
            for i, v in enumerate(votes):
                sums[kind, i, v][0] += n * p[kind, votes]
                sums[kind, i, v][1] += n * (1 - p[kind, votes])
        model = pii.reliabilities([(*k, *s) for k, s in sums.items()])
        for kind, votes in patterns:
            odds = log(model.prior[kind] / (1 - model.prior[kind])) + sum(log(a / b) for a, b in (model.reliability[kind, i, v] for i, v in enumerate(votes)))
            p[kind, votes] = 0.0 if votes[0] == "-" else 1 / (1 + exp(-odds))
    weights = defaultdict(lambda: [0.0, 0.0])
    for xs in found:
        for x in xs:
            for f in x.features:
                weights[x.kind, f][0] += p[x.kind, x.votes]
                weights[x.kind, f][1] += 1 - p[x.kind, x.votes]
    for (kind, f), (t, u) in weights.items():
        true, false = (sum(w[y] for (k, _), w in weights.items() if k == kind) + 0.5 * pii.BUCKETS for y in (0, 1))
        model.weights[kind, f] = log((t + 0.5) / true) - log((u + 0.5) / false)
    return model


def test_training(spark):
    rows, _ = private_rows()
    found = pii.scanned(frame(spark, rows))
    got, want = pii.train(found), trained_plainly([r.found for r in found.collect()])
    assert got.prior == pytest.approx(want.prior) and got.weights == pytest.approx(want.weights, abs=1e-6)
    for k, pair in got.reliability.items():
        assert pair == pytest.approx(want.reliability[k], abs=1e-6)
    scored = found.select(F.explode("found").alias("x")).select("x", pii.score(got, F.col("x")).alias("s")).collect()
    for r in scored:
        assert r.s == pytest.approx(log(got.prior[r.x.kind] / (1 - got.prior[r.x.kind])) + sum(got.weights[r.x.kind, f] for f in r.x.features), abs=1e-6)


# archives of others, and decoding


def test_archives_of_others(spark, tmp_path):
    """Any name, packed or not, digests in base32 or hex, records without a target, and repeated rows by names of their own."""
    body = b"<p>hello</p>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body

    def record(kind, block, **fields):
        lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}-{len(block)}>", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
        return "WARC/1.0\r\n".encode() + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    sha = hashlib.sha1(http).digest()
    packed = gzip.compress(record("warcinfo", b"software: x\r\n")) + gzip.compress(record("response", http, WARC_Target_URI="http://a/", Content_Type="application/http; msgtype=response", WARC_Payload_Digest="sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode(), WARC_Block_Digest="sha1:" + base64.b32encode(sha).decode()))
    (tmp_path / "a.warc.gz").write_bytes(packed)
    (tmp_path / "b.warc").write_bytes(record("resource", body, WARC_Target_URI="http://b/", WARC_Payload_Digest="SHA1:" + hashlib.sha1(body).hexdigest().upper()) + record("revisit", b"", WARC_Refers_To="<urn:uuid:1>"))
    got = {r.record_type: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert set(got) == {"warcinfo", "response", "resource", "revisit"} and got["response"].payload == body and got["resource"].payload == body and got["revisit"].payload is None
    assert got["response"].digest == got["resource"].digest == hashlib.sha1(body).hexdigest() and got["warcinfo"].url is None and got["response"].page_id is None and got["response"].record_id == f"<urn:uuid:response-{len(http)}>"
    (tmp_path / "c.warc").write_bytes(record("resource", b"other", WARC_Payload_Digest="sha1:" + hashlib.sha1(body).hexdigest()))
    with pytest.raises(Exception, match="doesn't have its digest"):
        warc.read_warc(spark, str(tmp_path / "c.warc")).count()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "notes.txt").write_bytes(b"no archive\r\n")
    with pytest.raises(Exception, match="version"):
        warc.read_warc(spark, str(tmp_path / "d")).count()
    payloads, headers = warc.archive_tables(spark.createDataFrame([(1, "u", "x" * 2000)] * 3, "page_id long, url string, html string"))
    warc.write_warc(warc.reconstructed(payloads, headers), str(tmp_path / "own"))
    own = warc.read_warc(spark, str(tmp_path / "own")).collect()
    assert len({r.record_id for r in own}) == 3 and [r.page_id for r in own] == [1] * 3 and sorted(r.record_type for r in own) == ["response", "revisit", "revisit"]


def test_viterbi_against_all_labellings():
    """The decoded labels of short chains score best of all 2^n, ties go to content, and chains don't touch each other."""
    rng = np.random.default_rng(4)
    for trial in range(60):
        counts = rng.integers(0, 9, rng.integers(1, 7))
        n = int(counts.sum())
        field = quality.Field(np.round(rng.normal(size=quality.N_FEATURES), 3), np.round(rng.normal(size=(2, 2)), 3) * (trial % 3 > 0))
        chosen = rng.integers(0, quality.N_FEATURES, (n, 4))
        labels, scores, at = field.decode(chosen, counts), field.scores(chosen), 0
        for c in counts.tolist():
            s = scores[at : at + c]
            value = lambda y: sum(s[k, v] for k, v in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
            best = max((value(y) for y in product((0, 1), repeat=c)), default=0.0)
            assert value(labels[at : at + c].tolist()) == pytest.approx(best)
            at += c
    tied = quality.Field()
    assert tied.decode(np.zeros((5, 2), np.int64), np.array([2, 3])).tolist() == [1] * 5
    assert quality.Field().decode(np.zeros((0, 2), np.int64), np.array([0, 0])).tolist() == []


# licences


def licensed(spark, *texts):
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(r.sentence_ids, r.licenses, r.n_sentences, r.n_unmatched) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_unknown_sentences_break_a_licence(spark):
    grant, notice = (next(s for s, i in licenses.SENTENCES.items() if i == x) for x in ("MITgrant", "MITnotice"))
    apache = [next(s for s, i in licenses.SENTENCES.items() if i == x) for x in ("ApacheRef", "ApacheUse", "ApacheCopy")]
    other = "An unrelated sentence stands here.\n"
    got = licensed(
        spark, f"{grant}:\n\n{notice}.", f"{grant}:\n{other * 50}{notice}.", f"{grant}:\n1.\n* and\n(a) {notice}.", f"{other}{grant}.\n{notice}.\n{other}", f"{apache[0]};\n{apache[1]}.\n{apache[2]}\n\n    http://www.apache.org/licenses/LICENSE-2.0\n",
        "SPDX-License-Identifier: Zlib\n", "// SPDX-License-Identifier: LGPL-2.1-or-later", None, "",
    )
    assert got[0] == ("MITgrant;MITnotice", "MIT", 2, 0) == got[2] == got[3]
    assert got[1] == ("MITgrant;UNKNOWN;MITnotice", "", 2, 2)
    assert got[4][1:] == ("Apache-2.0", 4, 0) and got[5][1] == "Zlib" and got[6][1] == "LGPL-2.1-or-later" and got[7] == got[8] == ("", "", 0, 0)


def test_every_licence_rule_fires(spark):
    """Each rule on its own sentences, one on a line, gives its licence and leaves nothing."""
    of = {i: s for s, i in licenses.SENTENCES.items()}
    got = licensed(spark, *["\n".join(of[i].capitalize() + "." for i in ids) for _, ids in licenses.RULES])
    for (name, ids), (sentence_ids, found, n, left) in zip(licenses.RULES, got):
        assert (sentence_ids, found, n, left) == (";".join(ids), name, len(ids), 0)

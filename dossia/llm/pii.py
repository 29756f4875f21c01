"""Personal data by weak supervision, native DataFrame functions only (operator 13).

Base spans come from four strict patterns with checks. Because a base pattern takes all it can and is not tried again when
its check fails, values that stand side by side are lost to it; so tight forms of the same kinds, obfuscated and
national ones among them, are candidates, and six labelers vote on each: two by regular expression (check and layout),
one by gazetteer (top-level domains, calling codes, card issuers, reserved networks) and three by context (words that
announce such a value, words that announce another, and what it is glued to). Expectation-maximisation over the counted vote
patterns of all documents estimates how reliable each labeler is for each kind and so how probable each pattern is; with these
probabilities a naive Bayes classifier over votes, shapes and neighbouring words is trained on all candidates, and it decides.

A candidate that touches a base span is not added, nor is one that fails the check of its kind. Vote patterns are at most 3^6 of each kind and classifier features are
hashed into BUCKETS, so what training brings to the driver doesn't grow with the data; all statistics cover all
documents, and no text is shuffled.

Null and empty texts have no spans; repeated rows are searched each; an empty table gives no rows and an untrained model, which
adds nothing; whole texts of any length are read, in time in proportion to them; other columns are ignored, but for those named in
`keep`. Places count code points, the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossia.functions.text import let, located, pieces, running, stretch
from dossia.llm.kernels import written

#: Kinds in the order in which spans are listed.
KINDS = ["email", "ip", "card", "phone"]
#: The strict patterns; possessive where nothing can be given back, so that long texts need no stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has no base span of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){12}[0-9]", "phone": r"\+[0-9]"}
#: Tight forms, one pattern: they don't overlap. Addresses of mail, of hosts, international telephone numbers, cards, national numbers.
_AT, _DOT = r"(?: ?[\[({] ?(?:at|AT) ?[\])}] ?| (?:at|AT) )", r"(?: ?[\[({] ?(?:dot|DOT) ?[\])}] ?| (?:dot|DOT) |\.)"
TIGHT = "|".join([
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{2,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}(?![A-Za-z0-9])",
    r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])",
    r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    r"\+[0-9]{9,15}(?![0-9])",
    r"\+[0-9]{1,3}(?:[ .-](?:\([0-9]{1,4}\)|[0-9]{1,4})){2,5}(?![0-9]|[ .-][0-9])",
    r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z])",
])
#: A text without a match of this has no tight form.
TIGHT_NEEDS = rf"@|{_AT}[A-Za-z0-9-]{{2,63}}{_DOT}|(?:[0-9A-Fa-f]:+){{2}}|[0-9]\.[0-9]{{1,3}}\.[0-9]|\+[0-9]|[0-9]{{13}}|[0-9]{{4}}[ -][0-9]{{4,6}}[ -]|[0-9]{{3}}\)? ?[-. ]?[0-9]{{3}}[-. ][0-9]{{4}}"
#: Words of four languages that announce each kind, and words that announce some other number.
ANNOUNCED = {
    "email": r"mail|contact|write|kontakt|schreib|correo|courriel|adresse|address|reach",
    "ip": r"\bip\b|ipv[46]|host|server|address|adresse|network|ping|client|login",
    "card": r"card|visa|master|amex|credit|debit|karte|tarjeta|carte|paid|payment",
    "phone": r"phone|\btel|call|mobil|\bfax|cell|ruf|anruf|llame|appel|contact|kontakt",
}
OTHERWISE = r"(?:version|release|isbn|issn|order|invoice|rechnung|factur|section|chapter|serial|sku|commit|token|sha[0-9]*|hash|build|rfc|pages?|password|key|uuid|doi|ratio|score)[^A-Za-z0-9]{0,4}$"
#: Top-level domains and international calling codes.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|me|eu|de|fr|es|it|nl|uk|us|ca|au|ch|at|be|pl|se|no|dk|fi|pt|cz|jp|cn|in|br|mx|ru|tw|kr|dev|app|name|example|test"
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1236-8]|22[0-9]|23[0-9]|24[0-9]|25[0-8]|26[0-9]|29[0179]|35[0-9]|37[0-9]|38[0-9]|42[0139]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|69[0-2]|85[02356]|88[06]|96[0-8]|97[0-7]|99[2-8]"
LABELERS = ["check", "layout", "gazetteer", "announced", "otherwise", "glued"]
#: Characters of context to each side, hash buckets of a kind's features, rounds of expectation-maximisation, rows that the prior counts for.
AROUND, BUCKETS, ROUNDS, TRUST = 40, 256, 12, 8.0
FOUND = "array<struct<kind:string,start:int,end:int,votes:string,features:array<int>>>"
SPANS = "array<struct<kind:string,start:int,end:int>>"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits, 19 at most, satisfy the check of card numbers."""
    from_right = F.reverse(number)

    def term(k: int) -> Column:
        d = F.coalesce(F.substr(from_right, F.lit(k + 1), F.lit(1)).try_cast("int"), F.lit(0))
        return d if k % 2 == 0 else 2 * d - F.when(d > 4, 9).otherwise(0)

    return sum((term(k) for k in range(1, 19)), term(0)) % 10 == 0


def octets(c: Column) -> Column:
    """Whether no part of a dotted address is over 255."""
    return ~F.exists(F.split(c, r"\."), lambda x: F.coalesce(F.regexp_replace(x, "^0+(?=[0-9])", "").try_cast("long") > 255, F.lit(True)))


def checked(kind: str, value: Column) -> Column:
    """The check of a base match."""
    n = F.length(digits(value))
    return {"email": F.lit(True), "ip": octets(value), "card": n.between(13, 19) & luhn(digits(value)), "phone": n.between(9, 15)}[kind]


def holds(kind: str):
    return lambda m: checked(kind, m["value"])


def of_kind(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))


def base_spans(text: Column) -> Column:
    """The base spans of all kinds, kind by kind in order."""
    none = F.array().cast("array<struct<value:string,start:int,end:int>>")
    each = []
    for kind, pattern in BASE.items():
        found = F.filter(F.when(text.rlike(NEEDS[kind]), located(text, pattern)).otherwise(none), holds(kind))
        each.append(F.transform(found, of_kind(kind)))
    return F.concat(*each)


def kind_of(value: Column) -> Column:
    number = F.length(digits(value))
    return (
        F.when(value.rlike("@|[\\[({ ](?:at|AT)[\\])} ]"), "email").when(value.contains(":") | value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when((number >= 13) & ~value.startswith("+"), "card").otherwise("phone")
    )


def by_kind(kind: Column, cases: dict[str, Column]) -> Column:
    first, *rest = cases.items()
    out = F.when(kind == first[0], first[1])
    for k, c in rest:
        out = out.when(kind == k, c)
    return out


def vote(yes: Column, no: Column) -> Column:
    return F.when(no, "-").when(yes, "+").otherwise("0")


def votes(kind: Column, value: Column, before: Column, after: Column) -> Column:
    """The votes of LABELERS in order, each `+`, `-` or `0` for none."""
    yes, no = F.lit(True), F.lit(False)
    d, dotted = digits(value), value.rlike(r"^[0-9.]+$")
    card, phone = F.length(d).between(13, 19) & luhn(d), F.length(d).between(9, 15)
    plain = value.contains("@")
    check = by_kind(kind, {"email": vote(plain, no), "ip": vote(~dotted | octets(value), dotted & ~octets(value)), "card": vote(card, ~card), "phone": vote(phone & value.startswith("+"), ~phone)})
    tidy_mail = value.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?(?:@|[^A-Za-z0-9@]{1,3}(?:at|AT)[^A-Za-z0-9]).*[A-Za-z]$")
    layout = by_kind(kind, {
        "email": vote(tidy_mail, ~tidy_mail), "ip": vote(~value.rlike(r"(^|\.)0[0-9]"), value.rlike(r"(^|\.)0[0-9]")),
        "card": vote(value.rlike("^(?:[0-9]{15,16}|[0-9]{4}[ -].*)$"), no), "phone": vote(value.rlike(r"^\+?[0-9]{0,3}[ .-]?\(|^\+[0-9]{1,3}[ .-]"), no),
    })
    domain = value.rlike(rf"(?i)(?:\.|[\])}} ])(?:{DOMAINS})$")
    reserved = value.rlike(r"^(?:0|22[4-9]|2[3-5][0-9])\.")
    issuer = value.rlike("^(?:4|5[1-5]|2[2-7]|3[4-7]|6[045])")
    calling = value.rlike(rf"^\+(?:{CALLING})")
    gazetteer = by_kind(kind, {"email": vote(domain, ~domain), "ip": vote(~reserved, reserved), "card": vote(issuer, ~issuer), "phone": vote(calling, value.startswith("+") & ~calling)})
    low = F.lower(before)
    announced = vote(by_kind(kind, {k: low.rlike(p) for k, p in ANNOUNCED.items()}), no)
    otherwise = vote(no, low.rlike(OTHERWISE))
    stuck = before.rlike(r"[A-Za-z0-9_=/\\#\"'$+.-]$") | after.rlike("^(?:[A-Za-z0-9_=/\\\\#\"'%@]|[.-][A-Za-z0-9])")
    return F.concat(check, layout, gazetteer, announced, otherwise, vote(~stuck & yes, stuck))


def shape(value: Column) -> Column:
    """Digits as 9 and words as a, runs of letters as one."""
    return F.regexp_replace(F.regexp_replace(value, "[A-Za-z]+", "a"), "[0-9]", "9")


def features(kind: Column, value: Column, before: Column, after: Column, voted: Column) -> Column:
    """Buckets of what the classifier sees of a candidate."""
    edge = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[A-Za-z]", "a"), "[0-9]", "9"), "[^\\x20-\\x7e]", "u")
    said = [F.concat(F.lit(f"v{i}"), F.substr(voted, F.lit(i + 1), F.lit(1))) for i in range(len(LABELERS))]
    said.append(F.concat(F.lit("s"), F.when(kind == "email", F.regexp_replace(shape(value), "9+", "9")).otherwise(shape(value))))
    said.append(F.concat(F.lit("w"), F.lower(F.regexp_extract(before, r"([A-Za-z]+)[^A-Za-z]*$", 1))))
    said.append(F.concat(F.lit("b"), edge(F.right(before, F.lit(1)))))
    said.append(F.concat(F.lit("a"), edge(F.left(after, F.lit(1)))))
    return F.array(*[F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int") for c in said])


def candidates(text: Column) -> Column:
    """The tight forms in a text, with votes and features."""
    def one(cut, m):
        sides = F.struct(kind_of(m["value"]).alias("kind"), stretch(cut, m["start"] - AROUND, m["start"]).alias("before"), stretch(cut, m["end"], m["end"] + AROUND).alias("after"), m["value"].alias("value"))
        voted = lambda s: F.struct(s.alias("s"), votes(s["kind"], s["value"], s["before"], s["after"]).alias("votes"))
        made = lambda x: F.struct(
            x["s"]["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), x["votes"].alias("votes"),
            features(x["s"]["kind"], x["s"]["value"], x["s"]["before"], x["s"]["after"], x["votes"]).alias("features"),
        )
        return let(sides, lambda s: let(voted(s), made))

    found = let(F.struct(pieces(text).alias("cut"), located(text, TIGHT).alias("found")), lambda x: F.transform(x["found"], lambda m: one(x["cut"], m)))
    return F.when(text.rlike(TIGHT_NEEDS), found).otherwise(F.array().cast(FOUND))


def scanned(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` in `row`, base spans in `base`, candidates in `found`: the one pass over the texts, kept as a table."""
    keep = ["doc_id"] if keep is None else keep
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return written(docs.select(F.struct(*keep).alias("row"), base_spans(text).alias("base"), candidates(text).alias("found")), "spans")


@dataclass
class Model:
    """What training found, by kind: the share of true candidates, each labeler's votes on true and on false ones, and the classifier's weights."""

    prior: dict[str, float] = field(default_factory=dict)
    reliability: dict[tuple[str, int, str], tuple[float, float]] = field(default_factory=dict)
    weights: dict[tuple[str, int], float] = field(default_factory=dict)


def probability(model: Model) -> Column:
    """How probable a vote pattern is to be true (columns kind and votes); what fails its kind's check is known to be false, which anchors the rest."""
    ratio = F.str_to_map(F.lit(",".join(f"{k}{i}{v}:{log(a / b):.12g}" for (k, i, v), (a, b) in model.reliability.items()) or "-:0"), F.lit(","), F.lit(":"))
    prior = by_kind(F.col("kind"), {k: F.lit(log(p / (1 - p))) for k, p in model.prior.items()})
    terms = [F.coalesce(F.try_element_at(ratio, F.concat("kind", F.lit(str(i)), F.substr("votes", F.lit(i + 1), F.lit(1)))).cast("double"), F.lit(0.0)) for i in range(len(LABELERS))]
    return F.when(F.startswith(F.col("votes"), F.lit("-")), 0.0).otherwise(1 / (1 + F.exp(-sum(terms, prior))))


def reliabilities(sums: list[tuple[str, int, str, float, float]]) -> Model:
    """The model after a round: (kind, labeler, vote, how many true, how many false), smoothed towards labelers better than chance."""
    model = Model()
    for kind in KINDS:
        own = {(i, v): (t, f) for k, i, v, t, f in sums if k == kind}
        true, false = (sum(own.get((0, v), (0, 0))[y] for v in "+-0") for y in (0, 1))
        model.prior[kind] = (true + 1) / (true + false + 2)
        for i in range(len(LABELERS)):
            for v, (up, down) in {"+": (0.5, 0.1), "-": (0.05, 0.5), "0": (0.45, 0.4)}.items():
                t, f = own.get((i, v), (0.0, 0.0))
                model.reliability[kind, i, v] = ((t + TRUST * up) / (true + TRUST), (f + TRUST * down) / (false + TRUST))
    return model


def train(found: DataFrame) -> Model:
    """Labelers' reliabilities by expectation-maximisation over all vote patterns, then the classifier over all candidates.

    Each round is an aggregate over the counted patterns; their number is bounded, and so is what comes back: 72 sums a round.
    """
    each = found.select(F.explode("found").alias("x")).select("x.kind", "x.votes", "x.features")
    patterns = written(each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "votes")
    # at first each labeler is trusted alike
    majority = F.length(F.regexp_replace("votes", "[^+]", "")) - F.length(F.regexp_replace("votes", "[^-]", ""))
    p = F.when(F.startswith(F.col("votes"), F.lit("-")), 0.0).otherwise(1 / (1 + F.exp(-1.5 * majority)))
    model = Model()
    for _ in range(ROUNDS):
        split = patterns.select("kind", "n", p.alias("p"), F.posexplode(F.split("votes", "")).alias("i", "v")).where("v <> ''")
        sums = split.groupBy("kind", "i", "v").agg(F.sum(F.col("n") * F.col("p")), F.sum(F.col("n") * (1 - F.col("p")))).collect()
        if not sums:
            return model
        model = reliabilities([tuple(r) for r in sums])
        p = probability(model)
    told = each.withColumn("p", p).select("kind", "p", F.explode("features").alias("f"))
    totals = told.groupBy("kind", "f").agg(F.sum("p").alias("t"), F.sum(1 - F.col("p")).alias("u")).collect()  # BUCKETS rows of a kind at most
    for kind in KINDS:
        own = [r for r in totals if r.kind == kind]
        true, false = sum(r.t for r in own) + 0.5 * BUCKETS, sum(r.u for r in own) + 0.5 * BUCKETS
        model.weights |= {(kind, r.f): log((r.t + 0.5) / true) - log((r.u + 0.5) / false) for r in own}
    return model


def score(model: Model, x: Column) -> Column:
    """The classifier's log odds of a candidate."""
    weights = F.str_to_map(F.lit(",".join(f"{k}{f}:{w:.12g}" for (k, f), w in model.weights.items()) or "-:0"), F.lit(","), F.lit(":"))
    prior = F.coalesce(by_kind(x["kind"], {k: F.lit(log(p / (1 - p))) for k, p in (model.prior or {"-": 0.5}).items()}), F.lit(-1.0))
    return F.aggregate(F.transform(x["features"], lambda f: F.coalesce(F.try_element_at(weights, F.concat(x["kind"], f.cast("string"))).cast("double"), F.lit(0.0))), prior, lambda a, w: a + w)


def merged(base: Column, added: Column) -> Column:
    """Base spans and those of `added` that touch none of them: a sweep over all by their start."""
    tagged = lambda c, own: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.lit(own).alias("own")))

    def swept(rows):
        last = running(F.transform(rows, lambda x: F.when(x["own"], x["end"]).otherwise(0)), F.greatest)
        upcoming = F.reverse(running(F.reverse(F.transform(rows, lambda x: F.when(x["own"], x["start"]).otherwise(2147483647))), F.least))
        free = let(F.struct(last.alias("last"), upcoming.alias("next")), lambda e: F.filter(rows, lambda x, i: x["own"] | ((F.get(e["last"], i) <= x["start"]) & (F.get(e["next"], i) >= x["end"]))))
        return free

    # of equal starts base spans come first
    rows = F.array_sort(F.concat(F.transform(tagged(base, True), lambda x: F.struct(x["start"], F.lit(0).alias("o"), x.alias("x"))), F.transform(tagged(added, False), lambda x: F.struct(x["start"], F.lit(1).alias("o"), x.alias("x")))))
    kept = let(F.transform(rows, lambda r: r["x"]), swept)
    order = lambda x: by_kind(x["kind"], {k: F.lit(i) for i, k in enumerate(KINDS)})
    ranked = F.array_sort(F.transform(kept, lambda x: F.struct(order(x).alias("r"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.transform(ranked, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def personal_data(docs: DataFrame, keep: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """The columns of `keep`, `base` and `spans` of each row, both by kind and start; without a model it is trained on these rows."""
    found = scanned(docs, keep)
    model = train(found) if model is None else model
    accepted = F.filter("found", lambda x: ~F.startswith(x["votes"], F.lit("-")) & (score(model, x) > 0))
    # most rows have nothing to add
    spans = F.when(F.size("found") > 0, merged(F.col("base"), accepted)).otherwise(F.col("base").cast(SPANS))
    return found.select("row.*", F.col("base").cast(SPANS).alias("base"), spans.alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """`doc_id, n_email, n_ip, n_card, n_phone` of base spans, their list's SHA-256, and all spans as a list."""
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *[n(k) for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

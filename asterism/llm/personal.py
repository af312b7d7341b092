"""Finds personal data in texts by weak supervision. DataFrame functions only.

Patterns propose spans. The base kinds (email, ip, card, phone) always stay. Further kinds are only
proposals: labelers look at the format (checksums, number ranges, grouping), at gazetteers, at cue words before
the span and at its edges, and vote for, against or not at all. A gazetteer also holds what the corpus
itself shows: names, banks and areas that stand after a cue word in ``KNOWN_IN`` rows. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is and how likely each pattern is personal data; a logistic
classifier learns these likelihoods from votes, kind and length, and decides which proposals stay.
There are at most a few thousand vote patterns whatever the corpus, so both are fitted on their counts.

Defined cases: a null or empty text has no spans; spans count code points, the end is exclusive; spans
of one kind never overlap; proposals that overlap a base span go; repeated rows, and rows with a null or
repeated id, are documents of their own and treated alike; no rows give no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

BASE = ("email", "ip", "card", "phone")
PROPOSED = ("ssn", "iban", "local_phone", "name")

# \G lets a match start where the one before ended; elsewhere a run of its first characters is
# entered at its start only, which finds the same matches without rescanning the run.
_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "local_phone": r"(?<![0-9A-Za-z+.(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame)\.? [A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?(?![A-Za-z])",
}
# a text without this has no valid match; most texts are settled here
_NEEDED = {
    "email": "@[A-Za-z0-9-]+[.]", "ip": "[0-9][.][0-9]+[.][0-9]", "card": "[0-9](?:[ -]?[0-9]){12}", "phone": "[+][0-9]",
    "ssn": "[0-9]-[0-9]{2}-[0-9]", "iban": "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "local_phone": "[0-9]{3}[ .-][0-9]{4}",
    "name": r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame)\.? [A-Z][a-z]",
}
_CUES = {
    "email": "mail|contact|write|schreib|correo|courriel|envoy", "ip": "ip|host|server|address|login|client",
    "card": "card|visa|credit|master|pay|karte|tarjeta|carte", "phone": "phone|tel|call|mobil|fax|anruf|llam|appel|dial",
    "ssn": "ssn|social|security|tax", "iban": "iban|account|bank|konto|cuenta|compte",
    "local_phone": "phone|tel|call|mobil|fax|dial|reach", "name": "by|from|with|contact|dear|sincerely|patient|von|para",
}
_AGAINST = "version|isbn|order|invoice|page|figure|section|chapter|price|total|rev|build"
_GAZETTEER = {  # ends of mail addresses, private and reserved nets, issuer digits, country codes, first names
    "email": r"[.](?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|ch|at|it|nl|us)$",
    "ip": r"^(?!0)(?!127\.)(?!255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^[+](?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": r"^(?:DE|FR|ES|GB|IT|NL|AT|CH|BE|PL|PT|SE|NO|DK|FI|IE)",
    "local_phone": r"^[(]?[2-9]",
    "name": r" (?:James|John|Mary|Anna|Maria|Peter|Paul|Thomas|Michael|David|Sarah|Laura|Jean|Pierre|Marie|Hans|Karl|Jose|Juan|Carlos|Ana)\b",
}
LABELERS = ("format", "gazetteer", "cue", "against", "edge")
KNOWN_IN = 3  # rows
SALTS = 16
_FORMAT = {  # (against, in favour): well-formed or sample values
    "email": (r"[.]{2}|^[.]|[.]@|@-|-[.]", r"[.][A-Za-z]{2,24}$"),
    "ip": (r"(?:^|[.])0[0-9]", r"^[0-9]{1,3}[.][0-9]{1,3}[.]"),
    "card": (
        r"^([0-9])(?:[ -]?\1)+$",
        r"^[0-9]{13,19}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}$",
    ),
    "phone": (r"[(][^)]*$|^[^(]*[)]|--|[.]{2}", r"[0-9][ ().-]+[0-9]"),
    "ssn": (r"^(?:000|666|9)|-00-|-0000$|^123-45-6789$|^([0-9])\1\1-\1\1-\1{4}$", "."),
    "local_phone": (r"^[(]?[01]|[ .-][01][0-9]{2}[ .-]|[(][0-9]{3}[ .-]", r"^(?:[(][0-9]{3}[)][ .-]|[0-9]{3}([ .-]))[0-9]{3}(?:\1|[ .-])[0-9]{4}$"),
    "name": (r" (?:The|This|That|And|But|For|With|Who|When|Will|Has|Was|Der|Die|Das|Und|Les|Des|Est)\b", r" [A-Z][a-z]+ [A-Z][a-z]+$"),
}
EM_ROUNDS = 40
FIT_ROUNDS = 300
CONTEXT = 40


def _valid(kind: str, found: Column) -> Column:
    """What a match of a base kind must fulfil beyond its pattern."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(found, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: F.when(F.length(p) > 3, F.lit(False)).otherwise(
            F.coalesce(p.try_cast("int"), F.lit(0)) <= 255
        ))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        def luhn(total, i):
            d = F.substring(digits, -i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return total + F.when(d > 9, d - 9).otherwise(d)

        total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), luhn)
        return F.length(digits).between(13, 19) & (total % 10 == 0)
    return F.lit(True)


def _raw_matches(kind: str) -> tuple[Column, Column]:
    """(matches, texts between them) of a kind; empty for texts that cannot have one."""
    there = F.rlike("text", F.lit(_NEEDED[kind]))
    pattern = F.lit(_PATTERN[kind])
    none = F.array().cast("array<string>")
    return (
        F.when(there, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(none),
        F.when(there, F.split("text", _PATTERN[kind], -1)).otherwise(none),
    )


def _iban_rest(found: Column) -> Column:
    """What the number of an account leaves when divided by 97; 1 for a valid one."""
    bare = F.replace(found, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))

    def step(rest, i):
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code <= 57, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def _format(kind: str, found: Column) -> Column:
    """Vote of the format: how well a match is built as its kind."""
    if kind == "iban":
        return F.when(_iban_rest(found) == 1, 1).otherwise(-1)
    against, in_favour = _FORMAT[kind]
    return _vote(F.rlike(found, F.lit(against)), F.rlike(found, F.lit(in_favour)))


def _key(kind: str, found: Column) -> Column:
    """What a gazetteer from the corpus knows a proposal by; null for base kinds."""
    if kind == "name":
        return F.regexp_extract(found, " ([A-Z][a-z]+)$", 1)
    if kind == "iban":
        bare = F.replace(found, F.lit(" "), F.lit(""))
        return F.concat(F.left(bare, F.lit(2)), F.substr(bare, F.lit(5), F.lit(4)))
    if kind in PROPOSED:
        return F.left(F.regexp_replace(found, "[^0-9]", ""), F.lit(3))
    return F.lit(None).cast("string")


def _vote(against: Column, in_favour: Column) -> Column:
    return F.when(against, -1).when(in_favour, 1).otherwise(0)


def _proposals(kind: str) -> Column:
    """(kind, start, end, votes, size) of a kind's valid matches, from its matches and gaps."""
    found, gaps = F.col(f"m_{kind}"), F.col(f"g_{kind}")
    placed = F.aggregate(
        F.sequence(F.lit(1), F.size(found)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<i:int,start:int,end:int>>").alias("all")),
        lambda so_far, i: F.struct(
            (so_far["at"] + F.char_length(F.get(gaps, i - 1)) + F.char_length(F.get(found, i - 1))).alias("at"),
            F.concat(so_far["all"], F.array(F.struct(
                i.alias("i"),
                (so_far["at"] + F.char_length(F.get(gaps, i - 1))).alias("start"),
                (so_far["at"] + F.char_length(F.get(gaps, i - 1)) + F.char_length(F.get(found, i - 1))).alias("end"),
            ))).alias("all"),
        ),
        lambda end: end["all"],
    )

    def proposal(p):
        match = F.get(found, p["i"] - 1)
        before = F.lower(F.right(F.get(gaps, p["i"] - 1), F.lit(CONTEXT)))
        after = F.get(gaps, p["i"])
        edges = F.rlike(before, F.lit("[a-z0-9]$")) | F.rlike(after, F.lit("^[A-Za-z0-9]"))
        votes = F.array(
            _format(kind, match),
            _vote(F.lit(False), F.rlike(match, F.lit(_GAZETTEER[kind]))),
            _vote(F.lit(False), F.rlike(before, F.lit(_CUES[kind]))),
            _vote(F.rlike(before, F.lit(_AGAINST)), F.lit(False)),
            _vote(edges, ~edges),
        )
        return F.struct(
            F.lit(kind).alias("kind"), p["start"].cast("long").alias("start"), p["end"].cast("long").alias("end"),
            votes.alias("votes"), F.least(F.char_length(match).cast("int") / 6, F.lit(4)).cast("int").alias("size"),
            _key(kind, match).alias("key"),
        )

    valid = F.filter(placed, lambda p: _valid(kind, F.get(found, p["i"] - 1)))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,votes:array<int>,size:int,key:string>>")
    return F.when(F.size(found) == 0, empty).otherwise(F.transform(valid, proposal))


def propose(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, proposals): valid base spans and unsettled further ones, row by row."""
    kinds = (*BASE, *PROPOSED)
    read = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(F.col(text)).alias("text"))
    raw = {}
    for kind in kinds:
        raw[f"m_{kind}"], raw[f"g_{kind}"] = _raw_matches(kind)
    return read.select("doc_id", *(c.alias(n) for n, c in raw.items())).select(
        "doc_id", F.concat(*(_proposals(k) for k in kinds)).alias("proposals")
    )


Pattern = tuple[str, tuple[int, ...], int]


def estimate(counts: dict[Pattern, int], rounds: int = EM_ROUNDS) -> dict[Pattern, float]:
    """Probability that a vote pattern is personal data, from agreement among labelers alone."""
    likely = {p: 1 / (1 + math.exp(-sum(p[1]))) for p in counts}
    for _ in range(rounds):
        votes = [[{v: 1.0 for v in (-1, 0, 1)} for _ in LABELERS] for _ in range(2)]
        mass = defaultdict(lambda: [1.0, 1.0])
        for (kind, vote, size), n in counts.items():
            for is_true, share in ((1, likely[kind, vote, size]), (0, 1 - likely[kind, vote, size])):
                mass[kind][is_true] += n * share
                for j, v in enumerate(vote):
                    votes[is_true][j][v] += n * share
        totals = [[sum(v.values()) for v in side] for side in votes]
        for pattern in counts:
            kind, vote, _ = pattern
            log = [math.log(mass[kind][c]) for c in (0, 1)]
            for j, v in enumerate(vote):
                for c in (0, 1):
                    log[c] += math.log(votes[c][j][v] / totals[c][j])
            likely[pattern] = 1 / (1 + math.exp(max(-60.0, min(60.0, log[0] - log[1]))))
    return likely


def _inputs(pattern: Pattern) -> list[str]:
    kind, vote, size = pattern
    return ["bias", f"kind {kind}", f"size {size}", *(f"{n} {v}" for n, v in zip(LABELERS, vote, strict=True) if v)]


def fit_classifier(counts: dict[Pattern, int], likely: dict[Pattern, float]) -> dict[str, float]:
    """Weights of a logistic classifier that learns the estimated probabilities."""
    weights: dict[str, float] = defaultdict(float)
    total = sum(math.log1p(n) for n in counts.values()) or 1.0
    for _ in range(FIT_ROUNDS):
        step: dict[str, float] = defaultdict(float)
        for pattern, n in counts.items():
            names = _inputs(pattern)
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, sum(weights[x] for x in names)))))
            for x in names:
                step[x] += math.log1p(n) * (likely[pattern] - p)
        for x, s in step.items():
            weights[x] += 2.0 * s / total - 0.001 * weights[x]
    return dict(weights)


def _accepted(weights: dict[str, float], p: Column) -> Column:
    score = F.lit(weights.get("bias", 0.0))
    for prefix, value, options in (("kind", p["kind"], PROPOSED), ("size", p["size"], range(5))):
        chosen = F.lit(0.0)
        for option in options:
            chosen = F.when(value == option, F.lit(weights.get(f"{prefix} {option}", 0.0))).otherwise(chosen)
        score = score + chosen
    for j, name in enumerate(LABELERS):
        vote = F.get(p["votes"], F.lit(j))
        score = score + (
            F.when(vote == 1, F.lit(weights.get(f"{name} 1", 0.0)))
            .when(vote == -1, F.lit(weights.get(f"{name} -1", 0.0))).otherwise(0.0)
        )
    return score > 0


def _with_corpus_votes(proposed: DataFrame) -> DataFrame:
    """``proposed`` with the gazetteer's vote for keys that stand after a cue word in at least KNOWN_IN rows.

    Rows without a key are not shuffled. Each key counts once per row and is counted before the shuffle; a key of
    very many rows meets SALTS copies of its one entry.
    """
    def keys(p):
        return F.array_distinct(F.transform(p, lambda x: F.struct(x["kind"].alias("kind"), x["key"].alias("key"))))

    gazetteer, cue = LABELERS.index("gazetteer"), LABELERS.index("cue")
    keyed = F.exists("proposals", lambda p: p["key"].isNotNull())
    some, none = proposed.filter(keyed), proposed.filter(~keyed)
    each = some.select("row", F.filter("proposals", lambda p: p["key"].isNotNull()).alias("p"))
    known = (
        each.select(F.explode(keys(F.filter("p", lambda x: F.get(x["votes"], F.lit(cue)) == 1))).alias("k"))
        .groupBy("k.kind", "k.key").agg(F.count("*").alias("n")).filter(F.col("n") >= KNOWN_IN)
        .select("kind", "key", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    )
    asked = each.select("row", F.explode(keys(F.col("p"))).alias("k")).select(
        "row", "k.kind", "k.key", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")
    )
    met = asked.join(known, ["kind", "key", "salt"]).groupBy("row").agg(F.collect_set(F.struct("kind", "key")).alias("known"))

    def settled(p):
        there = F.exists("known", lambda k: (k["kind"] == p["kind"]) & (k["key"] == p["key"]))
        votes = F.transform(p["votes"], lambda v, j: F.when((j == gazetteer) & there, 1).otherwise(v))
        return p.withField("votes", votes)

    voted = some.join(met, "row", "left").withColumn(
        "proposals", F.when(F.col("known").isNull(), F.col("proposals")).otherwise(F.transform("proposals", settled))
    )
    return voted.select("doc_id", "proposals").union(none.select("doc_id", "proposals"))


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): every base span and the proposals that the trained classifier keeps.

    Texts are read once; the spans proposed are stored, and only they, vote patterns and counts are shuffled.
    """
    proposed = stored(propose(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    proposed = stored(_with_corpus_votes(proposed))
    rows = (
        proposed.select(F.explode("proposals").alias("p")).groupBy("p.kind", "p.votes", "p.size")
        .agg(F.count("*").alias("n")).collect()
    )
    counts = {(r.kind, tuple(r.votes), r["size"]): r.n for r in rows}
    weights = fit_classifier(counts, estimate(counts))
    base = F.filter("proposals", lambda p: p["kind"].isin(*BASE))
    more = F.filter("proposals", lambda p: ~p["kind"].isin(*BASE) & _accepted(weights, p))
    apart = F.filter(more, lambda p: ~F.exists(base, lambda b: (b["start"] < p["end"]) & (p["start"] < b["end"])))
    bare = F.transform(
        F.concat(base, apart), lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"))
    )
    return proposed.select("doc_id", bare.alias("spans"))

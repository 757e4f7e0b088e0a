"""Personal data by weak supervision: labelers vote on candidate spans, their reliabilities are estimated, and a span
classifier trained on the estimates decides.

Candidates are the base patterns (email, ip, card, phone) and looser forms beside them (spelled-out addresses, phone
numbers without a country code, and secrets: long tokens of letters and digits, as keys and passwords are). Three labelers vote yes, no or abstain on each: its form (regex), its parts (gazetteer
of endings, issuer digits, country codes, networks, prefixes of keys) and its surroundings (context words, glued characters). Votes are
counted by kind and pattern, at most 135 rows; expectation-maximisation over these rows gives every pattern its
probability. Candidates weighted by it train a naive Bayes classifier for each kind over span features, again counted in a
table of fixed size. Base spans always stay; a looser one is added if the classifier gives it at least ``least``.

Positions are code points: texts are split at the matches of a pattern, and lengths of gaps and matches are summed. All
patterns are written so that Java scans them in linear time with the meaning of the plain ones.

Defined cases: null text counts as empty; no candidates give empty results; null or repeated ids and repeated rows are
worked on row by row (nothing is joined); very long texts are searched whole; spans that begin at one place stand by kind
and are all told; a probability equal to ``least`` is enough; columns other than doc_id and text are not looked at; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.llm.common import let, read, stored, text_or_empty

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret"]
LEAST, ROUNDS, SMOOTH = 0.9, 20, 1.0
_L = "A-Za-z0-9._%+-"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: kind -> (cheap test of the whole text, pattern, must hold for a match)
_BASE = [
    ("email", lambda t: t.contains("@"), rf"(?:\G|(?<![{_L}]))[{_L}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"),
    ("ip", lambda t: t.rlike("[0-9]"), r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", lambda t: t.rlike("[0-9]"), r"[0-9](?:[ -]?[0-9])++"),
    ("phone", lambda t: t.contains("+"), r"\+[0-9][ ().0-9-]+[0-9]"),
]
_LOOSE = [
    ("email", lambda t: t.rlike(r"[\[(]"), rf"(?<![{_L}])[{_L}]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]+(?:(?: ?[\[(] ?dot ?[\])] ?|\.)[A-Za-z0-9-]+)+"),
    ("phone", lambda t: t.rlike("[0-9]"), r"(?<!\+[0-9 ().-]{0,24})(?<![0-9A-Za-z.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z.-])"),
    ("secret", lambda t: t.rlike("[0-9]"), r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"),
]
# Gazetteers and context words.
_ENDINGS = "com org net edu gov info io de fr es uk eu us ca ch at it nl be"
_CONTEXT = {
    "email": "mail email e-mail contact address contacto correo courriel",
    "ip": "ip host server address adresse servidor",
    "card": "card visa credit payment karte carte tarjeta",
    "phone": "call phone tel telephone mobile telefon telefono",
    "secret": "token key apikey secret password passwd pwd credential credentials bearer authorization",
}
_KEYS = "AKIA ASIA ghp_ gho_ ghs_ github_pat_ glpat- xoxb- xoxp- sk- sk_live_ pk_live_ AIza eyJ hf_ npm_"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": F.when(n.between(12, 19), luhn(_digits(match))).otherwise(False),
        "phone": n.between(9, 15),
        "secret": (n >= 4) & match.rlike("[A-Za-z]"),
    }[kind]


def _before(sizes: Column, block: int = 256) -> Column:
    """Sum of all earlier values, for each place; by blocks, so that many matches in a text stay cheap."""
    add = lambda a, x: a + x
    zero = F.lit(0)
    starts = F.sequence(F.lit(0), F.floor(F.size(sizes) / block).cast("int"))
    sums = F.transform(starts, lambda b: F.aggregate(F.slice(sizes, b * block + 1, block), zero, add))
    running = F.aggregate(sums, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return let(
        running,
        lambda r: F.transform(sizes, lambda x, i: F.get(r, F.floor(i / block).cast("int")) + F.aggregate(F.slice(sizes, F.floor(i / block).cast("int") * block + 1, i % block), zero, add)),
    )


def _matches(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """Spans of all matches that hold: kind number, start, end, match, up to 24 characters before and one after."""

    def spans(found: Column) -> Column:
        def placed(gaps: Column) -> Column:
            sizes = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))

            def made(starts: Column) -> Column:
                every = F.transform(found, lambda m, i: F.struct(
                    (F.get(starts, i) + F.length(F.get(gaps, i))).alias("start"),
                    F.lit(KINDS.index(kind)).alias("kind"),
                    (F.get(starts, i) + F.length(F.get(gaps, i)) + F.length(m)).alias("end"),
                    m.alias("match"), F.right(F.get(gaps, i), F.lit(24)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("right"), F.lit(base).alias("base"),
                ))
                return F.filter(every, lambda s: _holds(kind, s["match"])) if base or kind == "secret" else every

            return let(_before(sizes), made)

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), placed))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def candidates(text: Column) -> Column:
    """All candidate spans of a text, by start and kind."""
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,match:string,left:string,right:string,base:boolean>>)")
    parts = [
        F.coalesce(F.when(test(text), _matches(text, kind, pattern, base)), none)
        for group, base in ((_BASE, True), (_LOOSE, False))
        for kind, test, pattern in group
    ]
    return F.sort_array(F.concat(*parts))


def _kind_case(s: Column, of) -> Column:
    found = F.lit(None)
    for i, kind in enumerate(KINDS):
        found = F.when(s["kind"] == i, of(kind)).otherwise(found)
    return found


def _votes(s: Column) -> list[Column]:
    """Form, gazetteer, context: 1 yes, 0 no, -1 abstains."""
    match, d = s["match"], _digits(s["match"])
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(-1)
    form = _kind_case(s, lambda k: {
        "email": vote(match.rlike(r"^[A-Za-z0-9][^@]{0,63}@.*[A-Za-z]{2,}$"), match.rlike(r"\.\.|-$")),
        "ip": vote(match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), F.lit(False)),
        "card": vote(F.length(d).isin(13, 15, 16), F.length(d) < 13),
        "phone": vote(F.length(d).between(10, 13), F.length(d) < 9),
        "secret": vote(match.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | (match.rlike("[a-z]") & match.rlike("[A-Z]") & ~match.rlike("[A-Za-z]{12}")), match.rlike("[A-Za-z]{12}")),
    }[k])
    gazetteer = _kind_case(s, lambda k: {
        "email": vote(F.lower(F.regexp_extract(match, r"([A-Za-z]+)$", 1)).isin(*_ENDINGS.split()), F.lit(False)),
        "ip": vote(match.rlike(r"^(?:[1-9][0-9]?|1[0-9]{2}|2[0-2][0-9])\."), match.rlike(r"^0")),
        "card": vote(d.rlike("^[3-6]"), d.rlike("^0")),
        "phone": vote(match.rlike(r"^\+(?:1|[2-9][0-9])"), d.rlike("^0{3}")),
        "secret": vote(match.rlike(f"^(?:{'|'.join(_KEYS.split())})"), match.rlike("^[0-9]+[_-]") | match.rlike("[_-][0-9]{1,6}$")),
    }[k])
    cue = _kind_case(s, lambda k: F.lower(s["left"]).rlike(rf"(?:^|[^a-z])(?:{'|'.join(_CONTEXT[k].split())})[^a-z0-9]{{1,4}}$"))
    # a secret is told by the name before it
    context = vote(cue, s["right"].rlike("[0-9A-Za-z]") | (s["kind"] == KINDS.index("secret")))
    return [form, gazetteer, context]


def _feature(s: Column) -> list[Column]:
    """Span features, each a small number."""
    return [
        F.least(F.length(s["match"]), F.lit(40)),
        F.least(F.length(_digits(s["match"])), F.lit(20)),
        F.when(s["left"].rlike("[0-9A-Za-z]$"), 2).when(s["left"].rlike(r"\s$"), 1).otherwise(0),
        F.when(s["right"].rlike("[0-9A-Za-z]"), 2).when(s["right"].rlike(r"\s"), 1).otherwise(0),
        *[v + 1 for v in _votes(s)],
    ]


def reliabilities(counts: dict[tuple, int], rounds: int = ROUNDS) -> dict[tuple, float]:
    """Probability of each (kind, votes), by expectation-maximisation; a labeler's yes and no rates are learned by kind."""
    given = {}
    for kind in {k[0] for k in counts}:
        rows = {k: n for k, n in counts.items() if k[0] == kind}
        n_votes = len(next(iter(rows))) - 1
        p = {k: min(max(sum(v == 1 for v in k[1:]) + 0.5, 0.5) / (sum(v >= 0 for v in k[1:]) + 1), 0.95) for k in rows}
        for _ in range(rounds):
            mass = [sum(n * (p[k] if c else 1 - p[k]) for k, n in rows.items()) + SMOOTH for c in (0, 1)]
            rate = [[[0.0] * n_votes for _ in range(3)] for _ in (0, 1)]
            for c in (0, 1):
                for j in range(n_votes):
                    seen = [sum(n * (p[k] if c else 1 - p[k]) for k, n in rows.items() if k[1 + j] == v) + SMOOTH * (2 if v == c else 1) for v in (-1, 0, 1)]
                    for v in range(3):
                        rate[c][v][j] = seen[v] / sum(seen)
            for k in rows:
                odds = [math.log(mass[c]) + sum(math.log(rate[c][k[1 + j] + 1][j]) for j in range(n_votes)) for c in (0, 1)]
                p[k] = 1 / (1 + math.exp(min(max(odds[0] - odds[1], -500), 500)))
        given |= p
    return given


def _number_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for item in sorted(values.items()) for x in item]) if values else F.expr("map('', 0.0D)")


def classifier(spans: DataFrame):
    """A function from a span to its probability; ``spans`` has a column s."""
    voted = spans.select(F.col("s"), *[v.alias(f"v{i}") for i, v in enumerate(_votes(F.col("s")))])
    counts = {tuple(r)[:-1]: r["n"] for r in voted.groupBy("s.kind", "v0", "v1", "v2").agg(F.count(F.lit(1)).alias("n")).collect()}
    p = reliabilities(counts) if counts else {}
    key = lambda s: F.concat_ws(",", s["kind"], *_votes(s))
    chance = _number_map({",".join(map(str, k)): x for k, x in p.items()})
    named = lambda s: F.array(*[F.concat_ws(",", s["kind"], F.lit(i), f) for i, f in enumerate(_feature(s))])
    weighed = spans.select(F.explode(named(F.col("s"))).alias("feature"), chance[key(F.col("s"))].alias("p"))
    rows = weighed.groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # features are bounded
    # naive Bayes for each kind: its own prior, and features among its own candidates
    mass = {kind: [sum(n * (p[k] if c else 1 - p[k]) for k, n in counts.items() if k[0] == kind) + SMOOTH for c in (1, 0)] for kind in {k[0] for k in counts}}
    total = lambda feature, c: mass[int(feature.split(",")[0])][c] + SMOOTH
    weight = {r["feature"]: math.log((r["yes"] + SMOOTH) / total(r["feature"], 0)) - math.log((r["no"] + SMOOTH) / total(r["feature"], 1)) for r in rows}
    weights, priors = _number_map(weight), _number_map({str(kind): math.log(yes / no) for kind, (yes, no) in mass.items()})

    def probability(s: Column) -> Column:
        odds = F.aggregate(F.transform(named(s), lambda f: F.coalesce(weights[f], F.lit(0.0))), F.coalesce(priors[s["kind"].cast("string")], F.lit(0.0)), lambda a, x: a + x)
        return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(500.0)), F.lit(-500.0))))

    return probability


def spans(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, spans: array of (start, kind, end, base, ...)."""
    found = stored(docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", candidates(F.col("text")).alias("spans")), "candidates")
    probability = classifier(found.select(F.explode("spans").alias("s")))
    return found.select("doc_id", F.filter("spans", lambda s: s["base"] | F.when(~s["base"], probability(s) >= least)).alias("spans"))


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _is_base(kind: int):
    return lambda s: s["base"] & (s["kind"] == kind)


def op4_personal_data(spark, sf_dir):
    found = spans(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _is_base(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    secrets = F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index("secret"))).cast("long").alias("n_secret")
    digests = [F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans")]
    return found.select("doc_id", *counts, *digests, secrets, F.size("spans").cast("long").alias("n_spans"))

"""Personal data by weak supervision, in DataFrame functions only.

1.  *Candidates.*  Patterns propose spans in every whole text.  The base patterns (email, ip,
    card, phone, see below) are certain: their spans stay.  Looser patterns propose more:
    spelled-out addresses, phone numbers without a plus, short or checksum-failing card
    numbers, national numbers and credentials.
2.  *Labelers* vote yes (1), no (0) or abstain (-1) on every candidate: a strict shape (regex),
    a gazetteer of words that announce such data, the context on both sides, a checksum.
3.  *Expectation-maximisation* over the counts of vote patterns estimates, without labels, how
    common true spans are in a kind and how reliable every labeler is.  The counts have at
    most ``len(KINDS) * 3**4`` rows whatever the corpus, so they come to the driver.
4.  A *span classifier* (logistic, one weight for each vote value and kind) is trained on the
    posteriors of step 3 and decides which proposed spans are added.

Null texts count as empty.  Rows without a span return zero counts, the hash of the empty
string and an empty ``spans``.  Repeated ids give a row each.  An empty table gives an empty
result.  Other columns are ignored.  Spans are in code points, end exclusive; an added span
never overlaps a base span of its own kind.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spill, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "id", "secret")
VOTERS = ("shape", "gazetteer", "context", "checksum")

#: The base patterns, in a form that finds the same leftmost matches in linear time and
#: without recursion: possessive quantifiers where giving back can't help, and a start that
#: isn't inside a run which has just been tried (\G: where the last match ended).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # only runs of 16 to 19 digits: others are dropped anyway
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every text with a match passes.
NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
#: Looser proposals.  Each match is taken with up to 24 characters before it (group 1).
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\}|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?[A-Za-z0-9-]{1,63})+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+.-])(?<!\+[0-9]{1,3}[\x20-]?)(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?=(?:\.*+[A-Za-z0-9_/+=~-]){12})[A-Za-z0-9_/+=~-]++(?:\.++[A-Za-z0-9_/+=~-]++)*+",
}
LOOSE_NEEDS = {
    "email": lambda t: t.rlike(r"(?:[(\[{]|\s)dot(?:[)\]}]|\s)"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.rlike(r"[0-9]{3}[.-][0-9]{4}(?![0-9-])"),
    "id": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
    "secret": lambda t: t.rlike(r"(?i)(?:token|secret|passw|api[_-]?key)[\"' a-z]{0,8}\s{0,3}[=:]"),
}
STRICT = {
    "email": r"(?:com|org|net|edu|gov|info|io|de|fr|es|uk)$",
    "card": r"^(?:[0-9]{4}[\x20-]?){3}[0-9]{4}$|^3[47][0-9]{13}$",
    "phone": r"^\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}$|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$",
    "id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "secret": r"[0-9a-f]{16,}|(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_/+-]{16,}",
}
GAZETTEER = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "card": r"(?i)\b(?:card|visa|amex|mastercard|credit|payment|account|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|t[eé]l[eé]phone|tel[eé]fono)\b",
    "id": r"(?i)\b(?:ssn|social|security|tax|passport|national|id)\b",
    "secret": r"(?i)token|secret|passw|key",
}
CONTEXT_YES = {
    "email": r"[:<(]\s?$",
    "card": r"[:#]\s?$",
    "phone": r"[:#]\s?$",
    "id": r"[:#]\s?$",
    "secret": r"\s$|^$",
}
CONTEXT_NO = {
    "email": r"[A-Za-z0-9]$",
    "card": r"[A-Za-z_=/.\"'-]$",
    "phone": r"[A-Za-z_=/\"]$",
    "id": r"[A-Za-z_=/\"]$",
    "secret": r"[A-Za-z0-9]$",
}
#: What is known of checksums beforehand: how often they pass for false spans and for true ones.
CHECKSUM_RATE = ((0.05, 0.3), (0.98, 0.999))
EM_ROUNDS, FIT_ROUNDS, FIT_RATE = 30, 200, 0.5
LEAST_SCORE = 0.5


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)),
        ),
        F.lit(0),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _spans(text: Column, pattern: str, needs: Column) -> Column:
    """array<struct<start, end, value, before>>: the matches of ``pattern`` in ``text``.

    ``split`` gives what lies between the matches that ``regexp_extract_all`` gives, so running
    lengths are the places.  Both run only for texts that pass the cheap test.
    """
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(parts.alias("p"), found.alias("m"))
    empty = F.array().cast("array<struct<start:long,end:long,value:string,before:string>>")
    walked = F.aggregate(
        F.filter(pairs, lambda x: x["m"].isNotNull()),
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
            F.concat(
                a["out"],
                F.array(
                    F.struct(
                        (a["at"] + F.length(x["p"])).alias("start"),
                        (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("end"),
                        x["m"].alias("value"),
                        F.right(x["p"], F.lit(24)).alias("before"),
                    )
                ),
            ).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(needs, walked).otherwise(empty)


def _passing(kind: str, spans: Column) -> Column:
    """Places of the base spans that pass their kind's check."""
    return F.transform(F.filter(spans, lambda x: _valid(kind, x["value"])), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def _named(kind: str, spans: Column, last: bool = False) -> Column:
    """The places with their kind, as the first field or the last."""
    name = F.lit(kind).alias("kind")
    return F.transform(spans, lambda x: F.struct(*[name] * (not last), x["start"].alias("start"), x["end"].alias("end"), *[name] * last))


def _voted(kind: str, spans: Column) -> Column:
    """Loose candidates with the labelers' votes."""
    return F.transform(
        spans,
        lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), *(v.alias(n) for n, v in _votes(kind, x).items())),
    )


def _accepted(weight: dict, kind: str, voted: Column) -> Column:
    """The candidates of a kind that the classifier takes."""
    mine = {k: w for k, w in weight.items() if k[0] == kind}
    return F.filter(voted, lambda x: (x["kind"] == kind) & (_score(mine, x) > LEAST_SCORE))


def _yes_no(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.otherwise(0) if no is None else out.when(no, 0).otherwise(-1)).cast("int")


def _votes(kind: str, x: Column) -> dict[str, Column]:
    """The labelers' votes on a loose candidate."""
    value, before = x["value"], x["before"]
    gazetteer = value if kind == "secret" else before
    if kind == "card":
        checksum = _yes_no(_luhn(_digits(value)))
    elif kind == "secret":  # a credential mixes digits and letters
        checksum = _yes_no(value.rlike(r"[0-9][^=:]*[a-fA-F]|[a-zA-Z][0-9]"))
    elif kind in ("phone", "id"):  # no digit repeated throughout
        checksum = F.when(value.rlike(r"^\D*([0-9])(?:\D*\1)+\D*$"), 0).otherwise(-1)
    else:
        checksum = F.lit(-1)
    return {
        "shape": _yes_no(value.rlike(STRICT[kind])),
        "gazetteer": _yes_no(gazetteer.rlike(GAZETTEER[kind]), F.lit(False)),
        "context": _yes_no(before.rlike(CONTEXT_YES[kind]), before.rlike(CONTEXT_NO[kind])),
        "checksum": checksum.cast("int"),
    }


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the valid base spans of each kind, and the loose candidates with their votes."""
    text = F.col("text")
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = base.select(
        "doc_id",
        *(_spans(text, BASE[k], NEEDS[k](text)).alias(f"base_{k}") for k in BASE_KINDS),
        *(_spans(text, LOOSE[k], LOOSE_NEEDS[k](text)).alias(f"loose_{k}") for k in LOOSE),
    )

    valid = [_passing(k, F.col(f"base_{k}")).alias(f"base_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *valid, F.flatten(F.array(*(_voted(k, F.col(f"loose_{k}")) for k in LOOSE))).alias("loose"))


def vote_counts(found: DataFrame) -> DataFrame:
    """How often each kind got each pattern of votes; at most ``len(KINDS) * 3**4`` rows."""
    return found.select(F.explode("loose").alias("x")).groupBy(*(F.col(f"x.{c}").alias(c) for c in ("kind", *VOTERS))).count()


def expectation_maximisation(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = EM_ROUNDS):
    """Posteriors for vote patterns, and the labelers' reliabilities, of a two-class model.

    ``patterns``: (kind, votes, count).  A checksum's rates are held to their known ranges.  Labelers are independent given the class; each kind
    has its own share of true spans and each labeler its own hit rate for both classes.
    Pseudo-counts say that labelers are right more often than not, which names the classes.
    """
    share = {k: 0.5 for k, _, _ in patterns}
    rate = {(k, j, y): (0.8 if y else 0.3) for k in share for j in range(len(VOTERS)) for y in (0, 1)}
    posterior: list[float] = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (k, votes, _) in enumerate(patterns):
            score = math.log(share[k]) - math.log(1 - share[k])
            for j, v in enumerate(votes):
                if v >= 0:
                    a, b = rate[k, j, 1], rate[k, j, 0]
                    score += math.log(a / b) if v else math.log((1 - a) / (1 - b))
            posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
        for k in share:
            mine = [(p, v, n) for p, (kk, v, n) in zip(posterior, patterns, strict=True) if kk == k]
            total = sum(n for _, _, n in mine)
            share[k] = min(0.99, max(0.01, (sum(p * n for p, _, n in mine) + 1) / (total + 2)))
            for j in range(len(VOTERS)):
                for y, (yes, no) in ((1, (8.0, 2.0)), (0, (3.0, 7.0))):
                    hit = sum((p if y else 1 - p) * n for p, v, n in mine if v[j] == 1)
                    miss = sum((p if y else 1 - p) * n for p, v, n in mine if v[j] == 0)
                    low, high = CHECKSUM_RATE[y] if VOTERS[j] == "checksum" else (0.01, 0.99)
                    rate[k, j, y] = min(high, max(low, (hit + yes) / (hit + miss + yes + no)))
    return posterior, share, rate


def fit_classifier(patterns: list[tuple[str, tuple[int, ...], int]], posterior: list[float], rounds: int = FIT_ROUNDS) -> dict:
    """Logistic weights for (kind,) and (labeler, vote), fitted to the posteriors by gradient descent."""
    weight: dict = {}
    total = sum(math.sqrt(n) for _, _, n in patterns) or 1.0
    for _ in range(rounds):
        step: dict = {}
        for (kind, votes, n), target in zip(patterns, posterior, strict=True):
            keys = [(kind,), *((kind, j, v) for j, v in enumerate(votes) if v >= 0)]
            guess = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight.get(k, 0.0) for k in keys)))))
            for k in keys:
                step[k] = step.get(k, 0.0) + (target - guess) * math.sqrt(n) / total
        for k, g in step.items():
            weight[k] = weight.get(k, 0.0) + FIT_RATE * len(KINDS) * g
    return weight


def learn(found: DataFrame) -> dict:
    """The span classifier's weights, from the candidates' votes."""
    rows = vote_counts(found).collect()  # bounded by the number of vote patterns
    patterns = [(r["kind"], tuple(r[c] for c in VOTERS), r["count"]) for r in sorted(rows, key=str)]
    return fit_classifier(patterns, expectation_maximisation(patterns)[0]) if patterns else {}


def _score(weight: dict, x: Column) -> Column:
    terms = [F.lit(0.0)]
    for key, w in sorted(weight.items(), key=str):
        test = x["kind"] == key[0]
        if len(key) == 3:
            test = test & (x[VOTERS[key[1]]] == key[2])
        terms.append(F.when(test, F.lit(float(w))).otherwise(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, terms)))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base spans of each kind, and ``spans``: array of (kind, start, end), all of them."""
    found = spill(candidates(docs, id_col, text_col), "pii")
    weight = learn(found)

    def of(kind: str) -> Column:
        base = F.col(f"base_{kind}") if kind in BASE_KINDS else F.array().cast("array<struct<start:long,end:long>>")
        added = F.filter(_accepted(weight, kind, F.col("loose")), lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        both = F.array_sort(F.concat(base, F.transform(added, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))))
        return _named(kind, both)

    return found.select("doc_id", *(f"base_{k}" for k in BASE_KINDS), F.flatten(F.array(*(of(k) for k in KINDS))).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """The digest columns over :func:`find_pii`."""
    base = F.flatten(F.array(*(_named(k, F.col(f"base_{k}")) for k in BASE_KINDS)))
    return find_pii(docs).select(
        "doc_id",
        *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``<KIND>`` (overlapping spans by the first).

    Rows are rewritten in place, so no join by id is needed: the classifier's weights come from
    a first pass and the candidates are found again in the second.  A null text stays null.
    """
    found = spill(candidates(docs, id_col, text_col).select("loose"), "pii-votes")
    weight = learn(found)
    text = text_or_empty(text_col)
    empty = F.array().cast("array<struct<start:long,end:long,kind:string>>")
    every = [_named(k, _passing(k, _spans(text, BASE[k], NEEDS[k](text))), last=True) for k in BASE_KINDS]
    every += [_named(k, _accepted(weight, k, _voted(k, _spans(text, LOOSE[k], LOOSE_NEEDS[k](text)))), last=True) for k in LOOSE]
    spans = F.array_sort(F.concat(empty, *every))
    taken = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(
            x["start"] >= a["at"],
            F.struct(
                x["end"].alias("at"),
                F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    return docs.withColumn(text_col, F.when(F.size(spans) > 0, taken).otherwise(F.col(text_col)))

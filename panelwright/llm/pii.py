"""Personal data with DataFrame functions only: labelers vote on spans, EM weighs them, a classifier decides."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Pattern kinds in the order in which spans with one start are listed; the method's kinds follow.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("local_phone", "id_number", "iban")
KINDS = BASE_KINDS + ADDED_KINDS

# A match may start where no earlier character of its class stands, or where the last match ended: the leftmost
# start is one of these, so long runs are read once. Possessive quantifiers never give back what they need not.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+.-])(?:\([0-9]{2,5}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9.-])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
# A cheap necessary condition, tested before a pattern is run.
_NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.contains(t, F.lit(".")) & t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?+[0-9]){11}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "local_phone": lambda t: t.rlike(r"[0-9]{3}[.\x20-][0-9]{4}"),
    "id_number": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
}

# Fixed values of the gazetteer labeler: common mail and country domains, issuer digits of cards, calling codes.
_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "it", "uk", "nl", "eu", "us", "info")
_CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_ISSUERS = r"^[3-6]"
_IBAN_COUNTRIES = ("DE", "FR", "ES", "IT", "NL", "GB", "BE", "AT", "CH", "PT", "PL", "IE", "LU")
# Fixed values of the context labeler, looked for in the characters before a span.
_FOR = {
    "email": "mail|contact|write|reply|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|login|from",
    "card": "card|visa|amex|credit|tarjeta|carte|karte|payment",
    "phone": "phone|call|tel|mobile|fax|contact|telefon",
    "local_phone": "phone|call|tel|mobile|fax|contact|telefon",
    "id_number": "ssn|social|security|id number|taxpayer",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
_AGAINST = "version|isbn|issn|order|invoice|serial|part|page|vol|chapter|section|https?|sha|build|release"
CONTEXT_CHARACTERS = 40
LABELERS = ("pattern", "gazetteer", "context", "border")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, joined, zero: int = 0) -> Column:
    """For each entry of an array what the earlier ones come to: sums or maxima of whole numbers.

    Blocks of about the root of the size are run through one by one, so the work grows
    with the size to the power of 1.5 at most, not with its square.
    """
    def through(block: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            block, first, lambda acc, v: F.struct(joined(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        )

    def blocks(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        count = F.ceil(F.size(v) / width).cast("int")
        return _let(width, lambda w: F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(v, i * w + 1, w)))

    def told(cut: Column) -> Column:
        totals = F.transform(cut, lambda block: F.aggregate(block, F.lit(zero), joined))
        starts = through(totals, F.lit(zero))["out"]
        return F.flatten(F.zip_with(cut, starts, lambda block, start: through(block, start)["out"]))

    empty = F.array().cast("array<int>")
    return _let(values, lambda v: F.when(F.size(v) > 0, _let(blocks(v), told)).otherwise(empty))


def _matches(text: Column, pattern: str) -> Column:
    """All matches with their places in code points: (start, end, value, before, touches).

    The texts between matches come from a split at the same pattern, so the places
    are running sums of lengths. ``before`` holds the characters between a match and the
    one before it, the last ``CONTEXT_CHARACTERS`` of them, ``touches`` the characters next to it on both sides.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def placed(s: Column) -> Column:
        found, gaps = s["found"], s["gaps"]
        lengths = F.transform(found, lambda m, i: F.length(gaps[i]) + F.length(m))

        def one(starts: Column, m: Column, i: Column) -> Column:
            start = starts[i] + F.length(gaps[i])
            earlier = F.when(i > 0, F.right(F.get(found, i - 1), F.lit(1))).otherwise("")
            later = F.coalesce(F.left(F.get(found, i + 1), F.lit(1)), F.lit(""))
            side = lambda gap, cut, other: F.when(F.length(gap) > 0, cut(gap, F.lit(1))).otherwise(other)
            return F.struct(
                start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"),
                F.right(gaps[i], F.lit(CONTEXT_CHARACTERS)).alias("before"),
                F.concat(side(gaps[i], F.right, earlier), side(gaps[i + 1], F.left, later)).alias("touches"),
            )

        return _let(_before(lengths, lambda a, b: a + b), lambda starts: F.transform(found, lambda m, i: one(starts, m, i)))

    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string,touches:string>>")
    return _let(both, lambda s: F.when(F.size(s["found"]) > 0, placed(s)).otherwise(empty))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the checksum over the digits, every second one from the right doubled, ends in 0."""
    places = F.sequence(F.lit(1), F.length(digits))

    def weigh(total, i):
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        doubled = F.when(digit >= 5, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(places, F.lit(0), weigh) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "id_number":
        return ~value.rlike(r"^(?:000|666|9[0-9]{2})|-00-|-0000$")
    if kind == "iban":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(F.coalesce(yes, F.lit(False)), 1)
    return (vote.when(F.coalesce(no, F.lit(False)), -1) if no is not None else vote).otherwise(0)


def _gazetteer(kind: str, value: Column) -> Column:
    if kind == "email":
        known = F.lower(F.substring_index(value, ".", -1)).isin(*_DOMAINS)
        return _vote(known, ~known)
    if kind in ("phone", "local_phone"):
        code = value.rlike(_CALLING_CODES) if kind == "phone" else value.rlike(r"^\(?[0-9]{3}")
        return _vote(code, ~code)
    if kind == "card":
        issuer = value.rlike(_ISSUERS)
        return _vote(issuer, ~issuer)
    if kind == "ip":
        return _vote(~value.rlike(r"^0+\.|^127\.|\.0\.0\.0$"), value.rlike(r"^0+\.|\.0\.0\.0$"))
    if kind == "iban":
        known = F.substring(value, 1, 2).isin(*_IBAN_COUNTRIES)
        return _vote(known, ~known)
    return F.lit(0)


def candidates(text: Column) -> Column:
    """Every raw match of every kind with the votes of the labelers on it.

    The pattern labeler votes on the kind's own rules (ranges, lengths, checksum),
    the gazetteer on known domains, codes and issuers, the context labeler on words
    before the span, the border labeler on what touches it.
    """
    def of(number: int, kind: str) -> Column:
        def judged(m):
            before, touches = F.lower(m["before"]), m["touches"]
            clean = ~touches.rlike(r"[0-9A-Za-z@_/]")
            valid = F.coalesce(_valid(kind, m["value"]), F.lit(False))
            return F.struct(
                F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), valid.alias("valid"),
                _vote(valid, ~valid).alias("v_pattern"), _gazetteer(kind, m["value"]).alias("v_gazetteer"),
                _vote(before.rlike(_FOR[kind]), before.rlike(_AGAINST)).alias("v_context"),
                _vote(clean, ~clean).alias("v_border"),
                F.least(F.floor(F.length(_digits(m["value"])) / 4), F.lit(6)).cast("int").alias("digits"),
            )

        listed = F.transform(_matches(text, PATTERNS[kind]), judged)
        return F.when(_NEEDS[kind](text), listed).otherwise(none)

    none = F.array().cast(
        "array<struct<kind:int,start:int,end:int,valid:boolean,v_pattern:int,v_gazetteer:int,v_context:int,"
        "v_border:int,digits:int>>"
    )
    found = F.concat(*[of(number, kind) for number, kind in enumerate(KINDS)])
    return F.when(text.isNotNull(), found).otherwise(none)


@dataclass
class Model:
    """Reliability of each labeler (chance of each vote for real and for false spans) and the span classifier."""

    reliability: dict[str, dict[str, list[float]]] = field(default_factory=dict)
    prior: dict[str, float] = field(default_factory=dict)
    bias: list[float] = field(default_factory=lambda: [-10.0] * len(KINDS))
    weights: list[float] = field(default_factory=lambda: [0.0] * (len(LABELERS) + 1))


def _em(kinds: np.ndarray, votes: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation of the two-class model with independent labelers; returns (posterior, tables, priors).

    Tables hold the chance of the votes -1, 0, 1 for false and real spans, priors
    the share of real spans of each kind; all are smoothed by one count. It starts
    from the share of favourable votes, which settles which class is the real one.
    """
    cast = (votes != 0).sum(axis=1)
    posterior = np.clip(((votes == 1).sum(axis=1) + 0.5) / (cast + 1.0), 0.02, 0.98)
    likelihood = -np.inf
    for _ in range(rounds):
        prior = np.array([
            (weight[kinds == k] @ posterior[kinds == k] + 1) / (weight[kinds == k].sum() + 2) for k in range(len(KINDS))
        ])
        tables = np.empty((votes.shape[1], 2, 3))
        for j in range(votes.shape[1]):
            for c, share in enumerate((1 - posterior, posterior)):
                counts = np.array([(weight * share)[votes[:, j] == v].sum() + 1 for v in (-1, 0, 1)])
                tables[j, c] = counts / counts.sum()
        log = np.stack([np.log(1 - prior[kinds]), np.log(prior[kinds])], axis=1)
        for j in range(votes.shape[1]):
            log += np.log(tables[j][:, votes[:, j] + 1].T)
        top = log.max(axis=1)
        total = top + np.log(np.exp(log - top[:, None]).sum(axis=1))
        posterior = np.exp(log[:, 1] - total)
        now = float(weight @ total)
        if abs(now - likelihood) <= 1e-9 * abs(now):
            break
        likelihood = now
    return posterior, tables, prior


def _logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression on soft targets by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (target - p)) - ridge * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(docs: DataFrame, text_column: str = "text") -> Model:
    """Learn reliabilities and the span classifier from the votes on all candidates.

    What reaches the driver is one row per pattern of votes: at most kinds times
    3^labelers times 7 sizes, whatever the corpus holds.
    """
    spans = docs.select(F.explode(candidates(docs[text_column])).alias("c")).select("c.*")
    columns = ["kind", *[f"v_{n}" for n in LABELERS], "digits"]
    rows = spans.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(*columns).collect()
    if not rows:
        return Model()
    kinds = np.array([r["kind"] for r in rows])
    votes = np.array([[r[f"v_{n}"] for n in LABELERS] for r in rows])
    digits = np.array([r["digits"] for r in rows], dtype=float)
    weight = np.array([r["n"] for r in rows], dtype=float)
    posterior, tables, prior = _em(kinds, votes, weight)
    x = np.hstack([np.eye(len(KINDS))[kinds], votes, digits[:, None]])
    beta = _logistic(x, posterior, weight)
    seen = np.bincount(kinds, weight, len(KINDS)) > 0
    return Model(
        {n: {"false": tables[j, 0].tolist(), "real": tables[j, 1].tolist()} for j, n in enumerate(LABELERS)},
        {k: float(p) for k, p in zip(KINDS, prior)},
        [float(b) if s else -10.0 for b, s in zip(beta, seen)], [float(b) for b in beta[len(KINDS):]],
    )


def accepted_spans(chosen: Column, model: Model) -> Column:
    """The spans among a column of candidates: (kind, start, end), by start, then kind as listed.

    Valid matches of the base kinds always stand. A span of an added kind stands if
    its own rules hold, the classifier says so and it overlaps no base span.
    """
    def accepted(c):
        score = F.element_at(F.array(*[F.lit(b) for b in model.bias]), c["kind"] + 1)
        for name, w in zip(LABELERS, model.weights):
            score = score + F.lit(w) * c[f"v_{name}"]
        return score + F.lit(model.weights[-1]) * c["digits"] > 0

    is_base = lambda c: c["kind"] < len(BASE_KINDS)
    base = F.filter(chosen, lambda c: is_base(c) & c["valid"])
    added = F.filter(chosen, lambda c: ~is_base(c) & c["valid"] & accepted(c))
    clear = F.filter(added, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    ordered = F.array_sort(F.transform(
        F.concat(base, clear), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("k"), c["end"].alias("end"))
    ))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.transform(ordered, lambda c: F.struct(
        F.element_at(names, c["k"] + 1).alias("kind"), c["start"].alias("start"), c["end"].alias("end")
    ))


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id and its spans (kind, start, end; code points, end exclusive).

    Two passes over the texts, no shuffle but of the vote counts. Null and empty
    texts have no spans, null ids stay null, repeated rows are answered each, other
    columns are ignored; without any candidate nothing is added.
    """
    model = fit(docs, text_column)
    # Candidates are a column of their own, so that the patterns run once.
    found = docs.select(docs[id_column].alias("doc_id"), candidates(docs[text_column]).alias("candidates"))
    return found.select("doc_id", accepted_spans(F.col("candidates"), model).alias("spans"))


def masked(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one.

    The text is cut into blocks of spans first and each block into its pieces, so no
    piece is looked for from the start of a long text.
    """
    def pieces(s: Column) -> Column:
        spans, upto = s["spans"], s["upto"]
        last = F.greatest(F.element_at(upto, -1), F.element_at(spans, -1)["end"])
        width = F.ceil(F.sqrt(F.size(spans))).cast("int")
        count = F.ceil(F.size(spans) / width).cast("int")

        def block(first: Column) -> Column:
            base = F.get(upto, first)
            end = F.coalesce(F.get(upto, first + width), last)
            cut = F.struct(first.alias("first"), base.alias("base"), F.substring(text, base + 1, end - base).alias("text"))
            return _let(cut, lambda b: F.array_join(F.transform(
                F.sequence(b["first"], F.least(b["first"] + width, F.size(spans)) - 1), lambda i: _let(
                    F.struct(F.get(spans, i).alias("span"), F.get(upto, i).alias("upto")),
                    lambda x: F.when(x["span"]["start"] < x["upto"], F.lit("")).otherwise(F.concat(
                        F.substring(b["text"], x["upto"] - b["base"] + 1, x["span"]["start"] - x["upto"]),
                        F.lit("["), F.upper(x["span"]["kind"]), F.lit("]"),
                    )))), ""))

        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: block(i * width))
        return F.concat(F.array_join(blocks, ""), F.substring(text, last + 1, F.length(text)))

    both = F.struct(found.alias("spans"), _before(F.transform(found, lambda s: s["end"]), lambda a, b: F.greatest(a, b)).alias("upto"))
    return F.when(F.size(found) > 0, _let(both, pieces)).otherwise(text)


def mask_documents(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents with personal data masked; ``n_chars``, where there is one, follows the new text."""
    model = fit(docs, text_column)
    found = docs.withColumn("_panelwright_candidates", candidates(docs[text_column]))
    found = found.withColumn("_panelwright_spans", accepted_spans(F.col("_panelwright_candidates"), model))
    found = found.withColumn("_panelwright_masked", masked(F.col(text_column), F.col("_panelwright_spans")))
    out = {text_column: F.col("_panelwright_masked")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = ~F.col(text_column).eqNullSafe(F.col("_panelwright_masked"))
        out["n_chars"] = F.when(changed, F.length("_panelwright_masked").cast(kind)).otherwise(F.col("n_chars"))
    return found.withColumns(out).select(*docs.columns)

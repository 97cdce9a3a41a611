"""Personal data by weak supervision, in DataFrame operations only.

Candidate spans come from strict patterns (the base: email, ip, card, phone) and from looser ones (addresses spelt
with "at" and "dot", phone numbers without a country code, IPv6 addresses, card numbers that fail the check digit).
Labelers vote on each candidate, for (1), against (-1) or not at all (0): the pattern, a gazetteer (top-level domains,
calling codes, issuer digits, reserved networks), the words before the span, and its borders. The votes are counted over
the corpus by pattern (at most ``4 kinds x 3 ** 4`` rows); expectation-maximisation on these counts estimates how reliable
each labeler is for true and false spans, and a logistic span classifier is trained on the resulting soft labels. Base
spans always stay; a looser candidate is added where the classifier gives it at least ``threshold`` and it overlaps no
base span and no earlier addition.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base, rewritten without backtracking: a match can only begin where a run of its first
# class begins or where the match before it ended (\G), and runs are possessive. They find the same spans in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]++(?: ?(?:\(dot\)|\[dot\]| dot ) ?[a-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: cheap tests that a text must pass before a pattern is tried
GATE = {
    ("email", 1): ("@", ""), ("ip", 1): ("", r"[0-9]\.[0-9]"), ("card", 1): ("", r"[0-9](?:[ -]?[0-9]){5}"), ("phone", 1): ("+", ""),
    ("email", 0): ("", r"(?i)[(\[ ]dot[)\] ]"), ("ip", 0): ("", "[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"), ("card", 0): ("", "[0-9]{4}[ -][0-9]{4}[ -]"), ("phone", 0): ("", "[0-9]{3}[ .-][0-9]{4}"),
}

# fixed values: gazetteer entries
DOMAINS = "com net org edu gov mil int info biz io ai co de fr es it uk us ca eu ch at nl be pl se no dk fi pt br mx ar jp cn in ru au"
CALLING = "1|7|2[07]|3[0123469]|4[013456789]|5[12345678]|6[0123456]|8[1246]|9[0123458]|[2-9][0-9]{2}"
ISSUER = "3|4|5|6|2[2-7]"
RESERVED = r"0|10|127|169\.254|192\.168|255|22[4-9]|23[0-9]"
CONTEXT_FOR = {"email": "e-?mail|mail|contact|write|reach|@", "ip": r"\bip\b|address|host|server|client|from", "card": "card|visa|master|amex|credit|debit|payment|account", "phone": "phone|tel|call|mobile|cell|fax|dial|contact"}
CONTEXT_AGAINST = {"email": "example of|such as", "ip": "version|release|section|chapter", "card": "isbn|order|serial|invoice|tracking", "phone": "isbn|order|serial|page"}
CONTEXT_CHARS = 24


def _matches(kind: str, strict: int) -> Column:
    """Array of structs (start, end, value) of a pattern's matches, in code points."""
    pattern = F.lit((BASE if strict else LOOSE)[kind])
    found = F.regexp_extract_all(F.col("__text"), pattern, F.lit(0))
    gaps = F.split(F.col("__text"), pattern, -1)
    # start of match i: all gaps up to it and all matches before it
    empty = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,value:string>>))")

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.length(z["gap"])
        end = start + F.length(z["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), z["value"].alias("value")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(1))), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    folded = F.aggregate(F.filter(pairs, lambda z: z["value"].isNotNull()), empty, step, lambda acc: acc["out"])
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    literal, test = GATE[kind, strict]
    gate = F.col("__text").contains(literal) if literal else F.col("__text").rlike(test)
    return F.when(gate, folded).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check-digit test."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _holds(kind: str, value: Column) -> Column:
    """The base's conditions on a match; a match that fails is dropped without another try."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"\A{_PART}\.{_PART}\.{_PART}\.{_PART}\z")
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(value))).otherwise(False)
    return n.between(10, 15)


def _gazetteer(kind: str, value: Column) -> Column:
    low = F.lower(value)
    if kind == "email":
        return F.when(low.rlike(rf"(?:\.|dot\)?\]? ?)(?:{DOMAINS.replace(' ', '|')})\z"), 1).otherwise(-1)
    if kind == "ip":
        return F.when(value.contains(":"), 0).when(value.rlike(rf"\A(?:{RESERVED})\."), -1).otherwise(1)
    if kind == "card":
        return F.when(value.rlike(rf"\A(?:{ISSUER})"), 1).otherwise(-1)
    return F.when(value.startswith("+"), F.when(_digits(value).rlike(rf"\A(?:{CALLING})"), 1).otherwise(-1)).otherwise(0)


def _votes(kind: str, strict: int, m: Column) -> Column:
    """A match as (kind, strict, start, end) with the four labelers' votes."""
    text = F.col("__text")
    before = F.lower(F.substring(text, F.greatest(m["start"] - CONTEXT_CHARS + 1, F.lit(1)), F.least(m["start"], F.lit(CONTEXT_CHARS))))
    context = F.when(before.rlike(CONTEXT_AGAINST[kind]), -1).when(before.rlike(CONTEXT_FOR[kind]), 1).otherwise(0)
    left = F.when(m["start"] > 0, F.substring(text, m["start"], F.lit(1))).otherwise(" ")
    right = F.substring(text, m["end"] + 1, F.lit(1))
    border = F.when(left.rlike(r"[\p{L}\p{N}_]") | right.rlike(r"[\p{L}\p{N}_]"), -1).otherwise(1)
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(strict).alias("strict"), m["start"].alias("start"), m["end"].alias("end"),
                    F.lit(strict).alias("v1"), _gazetteer(kind, m["value"]).alias("v2"), context.alias("v3"), border.alias("v4"))


def _kept(kind: str, m: Column) -> Column:
    return _holds(kind, m["value"])


def _bound(f, *given):
    """``f`` with its first arguments given: a function of one column."""
    return lambda x: f(*given, x)


def _order(a: Column, b: Column) -> Column:
    return F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["kind"] - b["kind"])


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__text`` (empty for null) and ``__c``: the candidates, sorted by start and kind."""
    found = docs.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    found = found.withColumns({f"__m_{kind}_{strict}": _matches(kind, strict) for kind in KINDS for strict in (1, 0)})
    parts = []
    for kind in KINDS:
        for strict in (1, 0):
            m = F.col(f"__m_{kind}_{strict}")
            good = F.filter(m, _bound(_kept, kind)) if strict else m
            parts.append(F.transform(good, _bound(_votes, kind, strict)))
    found = found.withColumn("__c", F.array_sort(F.concat(*parts), _order))
    return found.select(*docs.columns, "__text", "__c")


def vote_counts(found: DataFrame) -> list[tuple]:
    """(kind, v1, v2, v3, v4, strict, n): at most 4 x 3 ** 4 x 2 rows."""
    c = found.select(F.explode("__c").alias("c")).select("c.*").groupBy("kind", "v1", "v2", "v3", "v4", "strict").count()
    return sorted(tuple(r) for r in c.collect())


def reliabilities(counts: list[tuple], rounds: int = 50) -> dict[tuple, float]:
    """Expectation-maximisation: the probability of a true span for each kind and pattern of votes.

    The labelers are independent given the truth; each has a distribution over its votes for true and for false spans,
    per kind, smoothed by one pseudo count with a prior in favour of honest votes.
    """
    post: dict[tuple, float] = {}
    for kind in range(len(KINDS)):
        rows = [(r[1:5], r[6]) for r in counts if r[0] == kind]
        merged: dict[tuple, int] = {}
        for v, n in rows:
            merged[v] = merged.get(v, 0) + n
        prior = 0.6
        honest = {1: {-1: 0.1, 0: 0.3, 1: 0.6}, 0: {-1: 0.6, 0: 0.3, 1: 0.1}}
        theta = {y: [dict(honest[y]) for _ in range(4)] for y in (0, 1)}
        p: dict[tuple, float] = {}
        for _ in range(rounds):
            for v in merged:
                s = [math.log((1 - prior, prior)[y]) + sum(math.log(theta[y][j][v[j]]) for j in range(4)) for y in (0, 1)]
                p[v] = 1 / (1 + math.exp(max(-50.0, min(50.0, s[0] - s[1]))))
            total = sum(merged.values())
            if not total:
                break
            prior = min(0.95, max(0.05, (sum(n * p[v] for v, n in merged.items()) + 6) / (total + 10)))
            for y in (0, 1):
                for j in range(4):
                    weight = {x: 10 * honest[y][x] for x in (-1, 0, 1)}
                    for v, n in merged.items():
                        weight[v[j]] += n * (p[v] if y else 1 - p[v])
                    s = sum(weight.values())
                    theta[y][j] = {x: w / s for x, w in weight.items()}
        post.update({(kind, *v): q for v, q in p.items()})
    return post


def _design(kind: int, v: tuple) -> list[float]:
    return [1.0, *[float(kind == k) for k in range(1, len(KINDS))], *[float(x == 1) for x in v], *[float(x == -1) for x in v]]


def span_classifier(counts: list[tuple], post: dict[tuple, float], rounds: int = 200, ridge: float = 1.0) -> list[float]:
    """Logistic weights fitted to the soft labels by gradient steps on the counted patterns."""
    rows = [(_design(r[0], r[1:5]), post[r[0], *r[1:5]], r[6]) for r in counts]
    width = len(_design(0, (0, 0, 0, 0)))
    w = [0.0] * width
    total = sum(n for _, _, n in rows) or 1
    for _ in range(rounds):
        g = [-ridge * x / total for x in w]
        for x, y, n in rows:
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
            for i in range(width):
                g[i] += n / total * (y - q) * x[i]
        w = [a + 2.0 * b for a, b in zip(w, g)]
    return w


def learn(found: DataFrame) -> list[float]:
    counts = vote_counts(found)
    return span_classifier(counts, reliabilities(counts))


def accepted(weights: list[float], threshold: float = 0.5) -> Column:
    """Array of (kind, start, end): base spans, and those looser ones that the classifier accepts."""
    limit = math.log(threshold / (1 - threshold))

    def likely(c: Column) -> Column:
        votes = [c["v1"], c["v2"], c["v3"], c["v4"]]
        terms = [F.lit(weights[0])]
        terms += [F.when(c["kind"] == k, weights[k]).otherwise(0.0) for k in range(1, 4)]
        terms += [F.when(v == 1, weights[4 + j]).when(v == -1, weights[8 + j]).otherwise(0.0) for j, v in enumerate(votes)]
        return reduce(lambda a, b: a + b, terms) >= limit

    strict = F.filter("__c", lambda c: c["strict"] == 1)
    loose = F.filter("__c", lambda c: (c["strict"] == 0) & likely(c) & ~F.exists(strict, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    empty = F.expr("named_struct('at', 0, 'out', filter(__c, c -> false))")
    first = F.aggregate(loose, empty, lambda acc, c: F.when(c["start"] >= acc["at"], F.struct(c["end"].alias("at"), F.concat(acc["out"], F.array(c)).alias("out"))).otherwise(acc), lambda acc: acc["out"])
    both = F.when(F.size(F.filter("__c", lambda c: c["strict"] == 0)) > 0, F.array_sort(F.concat(strict, first), _order)).otherwise(strict)
    return F.transform(both, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["strict"].alias("strict")))


def spelled(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id and ``spans``, an array of (kind, start, end, strict) in code points, end exclusive.

    Null and empty texts have no spans. Rows that repeat an id are handled each for itself. Spans of different kinds
    may overlap in the base. An empty table gives an empty result; other columns are ignored.
    """
    found = materialize(candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "__c"), "pii")
    return found.select("doc_id", accepted(learn(found)).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", weights: list[float] | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced by ``[KIND]``; overlapping spans become one mark, of the first kind.

    All columns stay in their order; null texts stay null.
    """
    if weights is None:
        weights = learn(candidates(docs.select(F.col(text_col).alias("text"))))
    names = docs.columns
    docs, text_col = docs.toDF(*[f"c{i}" for i in range(len(names))]), f"c{names.index(text_col)}"  # no column of the table's meets those added here
    found = candidates(docs, text_col)
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.expr("named_struct('at', 0, 'out', cast('' as string))")

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(F.col("__text"), acc["at"] + 1, s["start"] - acc["at"]), F.element_at(name, s["kind"] + 1))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), fresh.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    marked = found.withColumn("__spans", accepted(weights))
    whole = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("__text"), acc["at"] + 1, F.length("__text"))))
    new = F.when(F.size("__spans") > 0, whole).otherwise(F.col("__text"))
    out = F.when(F.col(text_col).isNull(), F.col(text_col)).otherwise(new)
    return marked.withColumn("__new", out).select(*[F.col("__new").alias(c) if c == text_col else F.col(c) for c in docs.columns]).toDF(*names)

"""Personal data by candidate gradient boosting, with DataFrame functions only.

Patterns give the base spans of kinds email, ip, card and phone (checked by part size, Luhn sum and digit count). Beyond
them high-recall generators propose candidates, overlapping at will: national ids, account numbers, local phone numbers,
spelt-out addresses, birth dates. Boosted trees over format and context features score each; those at or above a threshold
calibrated on held-out examples, and clear of base spans, are spans of the generator's kind. Base spans always stay.

The trees are learned from labelled examples that a fixed generator writes (EXAMPLES of them, on the driver: formats in
credible and in misleading contexts), featurised by the very expressions that run on documents, and become CASE
expressions. Spans are in code points, end exclusive. Patterns that could start anywhere in a run only start at its
beginning or where the last match ended, which finds the same matches in linear time. Null or empty texts have no spans.
"""

from __future__ import annotations

import functools
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts

BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "nid": r"(?<![0-9-])[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "spelt": r"(?:\G|(?<![A-Za-z0-9._-]))[A-Za-z0-9._-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++",
    "birth": r"(?<![0-9./-])[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}(?![0-9])",
}
KINDS = (*BASE, *MORE)
#: What a text must hold before the pattern is tried.
_GUARD = {
    "email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.contains("+"), "spelt": lambda t: t.rlike(r"[\[(]at[\])]"),
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CONTEXT = 40
WORDS = {
    "name": r"(?i)\b(?:ssn|social|national|tax|insurance|id card|passport)",
    "bank": r"(?i)\b(?:iban|account|bank|konto|cuenta|compte|transfer)",
    "call": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|ring|text me|contact|whatsapp)",
    "mail": r"(?i)\b(?:mail|email|e-mail|write|contact|reach|address)",
    "born": r"(?i)\b(?:born|birth|dob|birthday|geboren|nacid|naiss)",
    "thing": r"(?i)\b(?:order|invoice|isbn|version|part|model|item|sku|serial|ref|case|page|released?|updated?|published|due|since|until|meeting|score|room|figure)",
}
FEATURES = ("kind", "length", "digits", "letters", "parts", *WORDS, "hash_before", "last_digit")
EXAMPLES, TREES, RATE, PRECISION = 3000, 24, 0.3, 0.95


def _found(text: Column, kind: str, pattern: str, guard=None) -> Column:
    """All matches as structs kind, s, e, m, in order: the text between matches tells where each begins."""
    none = F.array().cast("array<struct<kind:string,s:int,e:int,m:string>>")

    def place(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = (acc["at"] + F.length(x["p"])).cast("int")
            e = (s + F.length(x["m"])).cast("int")
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

        return F.aggregate(parts, start, step, lambda acc: acc["out"])

    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(between, matches, lambda p, m: F.struct(p.alias("p"), m.alias("m"))), lambda x: x["m"].isNotNull())
    test = guard(text) if guard else text.rlike(pattern)
    return F.when(test, place(pairs)).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda m: F.when(F.length(_digits(m)).between(14, 19), _luhn(_digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def base_spans(text: Column) -> Column:
    def valid(kind: str):
        return lambda x: _VALID[kind](x["m"])

    return F.concat(*(F.filter(_found(text, k, p, _GUARD.get(k)), valid(k)) for k, p in BASE.items()))


def candidates(text: Column) -> Column:
    """What the generators propose, each with the CONTEXT code points before it."""
    found = F.concat(*(_found(text, k, p, _GUARD.get(k)) for k, p in MORE.items()))
    before = lambda x: F.substring(text, F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT)))
    return F.transform(found, lambda x: F.struct(x["kind"], x["s"], x["e"], x["m"], before(x).alias("before")))


def features(x: Column) -> dict[str, Column]:
    """Numbers that the trees split on, of a candidate (kind, s, e, m, before)."""
    m, before = x["m"], x["before"]
    which = F.lit(0)
    for i, k in enumerate(MORE):
        which = F.when(x["kind"] == k, i).otherwise(which)
    out = {
        "kind": which, "length": F.length(m), "digits": F.length(_digits(m)), "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        "parts": F.size(F.split(m, r"[\x20./()-]+")),
    }
    out |= {k: before.rlike(p).cast("int") for k, p in WORDS.items()}
    out["hash_before"] = before.rlike(r"[#$€v/]\x20?$").cast("int")
    out["last_digit"] = F.when(F.length(_digits(m)) > 0, F.substring(_digits(m), -1, 1).cast("int")).otherwise(-1)
    return out


def examples(n: int = EXAMPLES) -> list[tuple[str, int]]:
    """Texts with one candidate each, and whether it is personal data; the same at every call."""
    r = random.Random(20)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8)))
    make = {
        "nid": lambda: f"{num(3)}-{num(2)}-{num(4)}" if r.random() < 0.7 else f"{num(3)} {num(2)} {num(4)}",
        "iban": lambda: r.choice(["DE", "FR", "ES", "GB"]) + num(2) + (sep := r.choice([" ", ""])) + sep.join(num(4) for _ in range(r.randint(3, 5))),
        "local": lambda: r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(num(3), num(3), num(4)),
        "spelt": lambda: f"{word()}{r.choice([' [at] ', '(at)', ' (at) ', '[at]'])}{word()}{r.choice([' [dot] ', '.', '(dot)'])}{r.choice(['com', 'org', 'net', 'de'])}",
        "birth": lambda: f"{r.randint(1, 28):02d}{(s := r.choice('./-'))}{r.randint(1, 12):02d}{s}{r.randint(1930, 2024)}",
    }
    good = {
        "nid": ["ssn ", "social security number: ", "national id ", "tax id: ", "insurance no. "], "iban": ["iban ", "account: ", "bank transfer to ", "konto ", "pay to iban: "],
        "local": ["phone: ", "call me at ", "tel. ", "my mobile is ", "fax ", "contact us on "], "spelt": ["mail ", "write to ", "email: ", "reach me at ", ""],
        "birth": ["born on ", "date of birth: ", "dob ", "birthday ", "geboren am "],
    }
    bad = ["order ", "invoice #", "isbn ", "version ", "part ", "model ", "item no. ", "sku ", "serial ", "case ref ", "page ", "released ", "updated ", "published on ", "due ", "meeting on ", "score ", ""]
    out = []
    for _ in range(n):
        kind, yes = r.choice(list(MORE)), r.random() < 0.5
        lead = r.choice(good[kind]) if yes else r.choice(bad)
        if not yes and kind == "spelt":
            lead = r.choice(["figure ", "item ", "version ", "page ", "score "])
        flip = r.random() < 0.02
        out.append((" ".join(word() for _ in range(r.randint(2, 6))) + " " + lead + make[kind]() + " " + word(), int(yes != flip)))
    return out


def boost(x: list[list[float]], y: list[int], trees: int = TREES, rate: float = RATE) -> tuple[float, list]:
    """Gradient boosting of the logistic loss with trees of depth two; Newton leaf values. A tree: (feature, cut, left, right)."""
    n, prior = len(y), math.log((sum(y) + 1) / (len(y) - sum(y) + 1))
    f, out = [prior] * n, []

    def best(rows: list[int], g: list[float], h: list[float]):
        total, weight, found = sum(g[i] for i in rows), sum(h[i] for i in rows), (1e-9, None, None)
        for k in range(len(FEATURES)):
            sums: dict[float, list[float]] = {}
            for i in rows:
                s = sums.setdefault(x[i][k], [0.0, 0.0])
                s[0] += g[i]
                s[1] += h[i]
            a = b = 0.0
            values = sorted(sums)
            for v, w in zip(values, values[1:], strict=False):
                a, b = a + sums[v][0], b + sums[v][1]
                gain = a * a / (b + 1) + (total - a) ** 2 / (weight - b + 1) - total * total / (weight + 1)
                if gain > found[0]:
                    found = (gain, k, (v + w) / 2)
        return found[1:]

    def grow(rows: list[int], g: list[float], h: list[float], depth: int):
        k, cut = best(rows, g, h) if depth else (None, None)
        if k is None:
            return rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)
        return k, cut, grow([i for i in rows if x[i][k] <= cut], g, h, depth - 1), grow([i for i in rows if x[i][k] > cut], g, h, depth - 1)

    for _ in range(trees):
        p = [1 / (1 + math.exp(-v)) for v in f]
        tree = grow(list(range(n)), [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p], 2)
        f = [v + leaf(tree, row) for v, row in zip(f, x, strict=True)]
        out.append(tree)
    return prior, out


def leaf(tree, row) -> float:
    while isinstance(tree, tuple):
        k, cut, left, right = tree
        tree = left if row[k] <= cut else right
    return tree


def calibrated(margins: list[tuple[float, int]], precision: float = PRECISION) -> float:
    """The lowest margin of (margin, label) from which on selections are right as often as asked; ties are selected together."""
    margins, hits, threshold = sorted(margins, reverse=True), 0, math.inf
    for n, (margin, label) in enumerate(margins, 1):
        hits += label
        if hits >= precision * n and (n == len(margins) or margins[n][0] < margin):
            threshold = margin
    return threshold


@functools.cache
def _learned(n: int, trees: int, rate: float, precision: float) -> tuple[float, list, float]:
    spark = SparkSession.active()
    made = spark.createDataFrame(examples(n), "text string, y int").withColumn("c", F.explode(candidates(F.col("text"))))
    rows = made.select("text", "y", *(v.cast("double").alias(k) for k, v in features(F.col("c")).items())).collect()
    rows.sort(key=lambda r: tuple(r))
    x, y = [[r[k] for k in FEATURES] for r in rows], [r["y"] for r in rows]
    prior, grown = boost(x[::2], y[::2], trees, rate)
    return prior, grown, calibrated([(prior + sum(leaf(t, v) for t in grown), label) for v, label in zip(x[1::2], y[1::2], strict=True)], precision)


def fit(spark: SparkSession) -> tuple[float, list, float]:
    """Prior, trees and the margin from which a candidate is selected; the same at every call, so learned once a process."""
    return _learned(EXAMPLES, TREES, RATE, PRECISION)


def _score(x: Column, prior: float, trees: list) -> Column:
    named = list(features(x).values())

    def case(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        k, cut, left, right = tree
        return F.when(named[k] <= cut, case(left)).otherwise(case(right))

    total = F.lit(prior)
    for t in trees:
        total = total + case(t)
    return total


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = F.create_map(*(F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)))
    keyed = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.try_element_at(rank, x["kind"]).alias("k"), x["e"].alias("e"), x["kind"].alias("kind")))
    return F.array_sort(keyed)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, base and added (arrays of s, k, e, kind, in order) of each row of docs (doc_id, text)."""
    prior, trees, threshold = fit(docs.sparkSession)
    d = texts(docs).select("doc_id", "text", _ordered(base_spans(F.col("text"))).alias("base"), candidates(F.col("text")).alias("proposed"))
    clear = lambda x: ~F.exists(F.col("base"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    chosen = F.filter("proposed", lambda x: clear(x) & (_score(x, prior, trees) >= threshold - 1e-9))
    return d.select("doc_id", "text", "base", _ordered(chosen).alias("added"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added of each row of docs (doc_id, text)."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    both = F.array_sort(F.concat("base", "added"))
    return spans(docs).select(
        "doc_id", *(count(k) for k in BASE), F.sha2(F.encode(_joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), _joined(both).alias("spans"), F.size("added").cast("long").alias("n_added")
    )

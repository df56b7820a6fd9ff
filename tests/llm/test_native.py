"""PII and SpotSigs against plain-Python versions, on planted and awkward texts and on the small documents table."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from brightloom.llm import pii, spotsigs

SF = "/root/testdata/sf0.001"
AWKWARD = [
    None, "", " ", "a@b.cc@d.ee x", "a@b.co_m@x.yy", "…é@x.com 🙂 a.b-c+d@mail-1.example.org.", "1.2.3.4.5.6.7.8 999.1.1.1 007.0.0.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111", "+1 (415) 555-0100. +44 20 7946 0958 +1-2 ++49 30 901820 ", "x" * 50_000, "1" * 30_000, "a.b" * 20_000,
    "ssn 123-45-6789 order 123-45-6789", "born on 12.03.1980 due 12/03/2020", "write to jo [at] mail [dot] com", "a@b" + ".c" * 5000, "5555555555554444",
]


def base(text):
    text, found = text or "", []
    found += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if "@" in text else []
    for m in re.finditer(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.createDataFrame([(i, t, "x") for i, t in enumerate(AWKWARD)], "doc_id long, text string, spans string")
    return own.union(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text", "lang"))


def test_pii(spark, docs):
    got = {r["doc_id"]: r for r in pii.scan(docs).collect()}
    assert len(got) == docs.count()
    for r in docs.select("doc_id", "text").collect():
        want, row = base(r["text"]), got[r["doc_id"]]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (r["doc_id"], joined, row["spans"])
        assert [row[f"n_{k}"] for k in pii.BASE] == [sum(w[0] == k for w in want) for k in pii.BASE]
        assert set(filter(None, joined.split(","))) <= set(row["spans"].split(","))
    assert "nid:4:15" in got[12]["spans"] and "nid:22" not in got[12]["spans"]
    assert "birth:8:18" in got[13]["spans"] and "birth:23" not in got[13]["spans"]
    assert "spelt:9:31" in got[14]["spans"]
    assert pii.scan(docs.where("false")).count() == 0


def test_pii_threshold_takes_ties_together():
    assert pii.calibrated([(3.0, 1), (2.0, 1), (1.0, 1), (1.0, 0), (1.0, 0)], 0.7) == 2.0
    assert pii.calibrated([(1.0, 1), (1.0, 0)], 0.5) == 1.0 and pii.calibrated([(1.0, 0)], 0.5) == float("inf") and pii.calibrated([], 0.5) == float("inf")


def spots(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    stop, out = set(spotsigs.ANCHORS), set()
    for i, w in enumerate(words):
        if w in stop:
            chain = [x for x in words[i + 1 :] if x not in stop][: 2]
            if len(chain) == 2:
                out.add((w, *chain))
    return out or {("", w) for w in words} or ({text} if text else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("rows", [3, 5000])
def test_spotsigs(spark, monkeypatch, rows):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", rows * 9)
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = table.union(spark.createDataFrame([(5000 + i, t) for i, t in enumerate([None, "", "!!", "the a", "word", "x" * 9000])], table.schema))
    all_ = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in spotsigs.edits(docs).collect()}
    assert len(got) == len(all_)
    for i, (doc, text) in enumerate(all_):
        nxt = all_[(i + 1) % len(all_)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + nxt[:cut]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(jaccard(spots(text), spots(edited)), abs=1e-6)
        assert r["near_next"] == pytest.approx(jaccard(spots(text), spots(nxt)), abs=1e-6)


def test_next_with_ties_and_nulls(spark):
    docs = spark.createDataFrame([(None, "n"), (1, "a"), (1, "b"), (1, "a"), (7, None)], "doc_id long, text string")
    assert spotsigs.edits(docs).count() == 5
    assert spotsigs.edits(docs.where("false")).count() == 0
    one = spotsigs.edits(docs.where("doc_id = 7")).first()
    assert (one["near_next"], one["near_edited"], one["fingerprint"]) == (1.0, 1.0, "")


def test_next_of_text_ids(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 10)
    made = sorted((f"id-{i * 37 % 101}é", f"text number {i} of the many") for i in range(101))
    got = {r["doc_id"]: r for r in spotsigs.with_next(spark.createDataFrame(made, "doc_id string, text string"), {}).collect()}
    assert [got[k]["next_text"] for k, _ in made] == [t for _, t in made[1:] + made[:1]]


def test_similar(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {}
    members, pairs = spotsigs.similar(docs, 0.5)
    ids = {r["doc_id"]: r["set_id"] for r in members.collect()}
    for r in docs.collect():
        sets[ids[r["doc_id"]]] = spots(r["text"])
    want = {frozenset((a, b)) for a in sets for b in sets if a != b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.5}
    assert {frozenset((r["a"], r["b"])) for r in pairs.collect()} == want

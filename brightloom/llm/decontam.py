"""Benchmark decontamination: training passages query a BM25 inverted index of test items through block-max WAND.

Every document is cut into overlapping passages of `window` words (at least twice the longest item, a step of half), so
each run of words as long as an item lies whole in one. A passage's distinct words are the query; contributions are
divided by the item's score for its own text, so one threshold fits all items. Items lie in blocks of BLOCK.

Pairs are verified on the whole document: of the item's five-word shingles at least `overlap` must occur there, and of
those of its question and of its answer (the last sentence, or the last third of a single one) at least half. So only
documents that hold that share of some item's shingles, found by the shingles' hashes, can match, and nothing that
verifies is missed. Their passages sum the blocks' maxima, those that reach the threshold in some block run block-max WAND
over the postings, and pairs that no passage retrieves, as the item lies scattered, are scored by their best passage.
Words are runs of letters, digits and underscores, lower-cased.

Statistics cover all items. The index is built and broadcast for at most INDEX_BYTES of item text at a time; more items
make more blocks, each of which scans the documents. Null or empty items match nothing, nor do documents without words.
Repeated rows of either table match as often as they occur.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import by_slices, ship, slices, texts

K1, B = 1.2, 0.75
BLOCK = 4
INDEX_BYTES = 32_000_000
THRESHOLD = 0.5
OVERLAP, PART_OVERLAP, WIDTH = 0.8, 0.5, 5
LEAST_WINDOW = 128
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?]+\s+(?=\S)")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def parts(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and of its answer."""
    ends = [m.end() for m in _SENTENCE.finditer(text.strip())]
    if ends:
        q, a = words(text.strip()[: ends[-1]]), words(text.strip()[ends[-1] :])
        if q and a:
            return q, a
    w = words(text)
    cut = len(w) - max(1, len(w) // 3)
    return w[:cut], w[cut:]


def _rolled(terms: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` terms in a row."""
    mixed, out = terms.astype(np.uint64) + np.uint64(1), np.zeros(max(0, len(terms) - width + 1), np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + len(out)] * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(32))


def shingles(w: list[str]) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + WIDTH]) for i in range(max(1, len(w) - WIDTH + 1))} if w else set()


class Index:
    """Postings by term, in the order of items, with the largest contribution of each block and of the whole list."""

    def __init__(self, items: list[tuple], n: int, average: float, df: dict[str, int]):
        """items: (id, text); n, average, df: number of items, their mean length, items by word, over all of them."""
        self.ids = [i for i, _ in items]
        bags = [Counter(words(t)) for _, t in items]
        self.longest = max((sum(b.values()) for b in bags), default=0)
        self.parts = [parts(t) for _, t in items]
        self.shingles = [shingles(words(t)) for _, t in items]
        found = defaultdict(list)
        for i, bag in enumerate(bags):
            length = sum(bag.values())
            norm = K1 * (1 - B + B * length / max(average, 1e-9))
            gain = {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in bag.items()}
            own = sum(gain.values()) or 1.0
            for w, g in gain.items():
                found[w].append((i, g / own))
        self.term = {w: k for k, w in enumerate(found)}
        self.items = [np.array([i for i, _ in p], np.int64) for p in found.values()]
        self.gains = [np.array([g for _, g in p]) for p in found.values()]
        self.blocks, self.maxima = [], []
        for i, g in zip(self.items, self.gains, strict=True):
            b, first = np.unique(i // BLOCK, return_index=True)
            self.blocks.append(b)
            self.maxima.append(np.maximum.reduceat(g, first))
        self.top = np.array([g.max() for g in self.gains])
        self.count = np.array([len(b) for b in self.blocks], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.flat_block = np.concatenate(self.blocks) if self.blocks else np.zeros(0, np.int64)
        self.flat_max = np.concatenate(self.maxima) if self.maxima else np.zeros(0)
        self.n_blocks = -(-len(items) // BLOCK)
        self.own: list[dict[int, float]] = [{} for _ in items]
        for w, p in found.items():
            for i, g in p:
                self.own[i][self.term[w]] = float(g)
        # by the width of items' shingles (less than WIDTH for shorter items): their hashes, sorted, and which items hold each
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        hashes = defaultdict(list)
        for i, own in enumerate(self.shingles):
            for x in own:
                hashes[len(x)].append((int(_rolled(np.array([self.term[w] for w in x]), len(x))[0]), i))
        for n, pairs in hashes.items():
            pairs = sorted(set(pairs))
            self.held[n] = np.array([h for h, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int64)
        self.need = np.array([max(1, int(np.ceil(OVERLAP * len(x) - 1e-9))) for x in self.shingles], np.int64)

    def candidates(self, terms: np.ndarray, unit: np.ndarray) -> dict[int, list[int]]:
        """By document, the items of which it holds enough shingles to verify.

        terms: all documents' words in a row (-1: of no item), unit: the document of each.
        """
        count: Counter = Counter()
        for n, (hashes, items) in self.held.items():
            at = np.arange(len(terms) - n + 1)
            known = np.concatenate([[0], np.cumsum(terms < 0)])
            at = at[(known[at + n] == known[at]) & (unit[at] == unit[at + n - 1])] if len(at) else at
            roll = _rolled(terms, n)[at] if len(at) else np.zeros(0, np.uint64)
            lo, hi = np.searchsorted(hashes, roll), np.searchsorted(hashes, roll, "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            there = np.unique(np.stack([unit[at[hit]], lo[hit], hi[hit]], axis=1), axis=0)  # each shingle once a document
            for d, a, b in there.tolist():
                for i in items[a:b].tolist():
                    count[d, i] += 1
        out = defaultdict(list)
        for (d, i), c in count.items():
            if c >= self.need[i]:
                out[d].append(i)
        return out

    def bounds(self, query: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Of n queries, given as pairs (query, term), those whose block maxima reach the threshold in some block."""
        count = self.count[term]
        at = np.repeat(self.first[term] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        cell = np.repeat(query, count) * self.n_blocks + self.flat_block[at]
        best = np.bincount(cell, self.flat_max[at], n * self.n_blocks).reshape(n, self.n_blocks)
        return np.flatnonzero(best.max(axis=1, initial=0) >= THRESHOLD - 1e-9)

    def best(self, item: int, query: np.ndarray, term: np.ndarray, first: int, end: int) -> float:
        """The item's largest score for the queries from first to end, given as pairs (query, term)."""
        a, b = np.searchsorted(query, [first, end])
        gain = np.array([self.own[item].get(t, 0.0) for t in term[a:b].tolist()])
        return float(np.bincount(query[a:b] - first, gain, max(1, end - first)).max())

    def wand(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Every item whose score for the terms reaches the threshold, by block-max WAND."""
        end, out = len(self.ids), []
        lists = [[int(self.items[t][0]), 0, t] for t in terms]
        threshold -= 1e-9

        def move(x: list, to: int) -> None:
            post = self.items[x[2]]
            x[1] += int(np.searchsorted(post[x[1] :], to))
            x[0] = int(post[x[1]]) if x[1] < len(post) else end

        while True:
            lists = sorted(x for x in lists if x[0] < end)
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                total += self.top[x[2]]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block, bound = item // BLOCK, 0.0
            for x in lists[: pivot + 1]:
                b = self.blocks[x[2]]
                k = int(np.searchsorted(b, block))
                if k < len(b) and b[k] == block:
                    bound += self.maxima[x[2]][k]
            if bound < threshold:  # no item of this block up to the next list's can reach it
                nxt = min((block + 1) * BLOCK, lists[pivot + 1][0] if pivot + 1 < len(lists) else end)
                for x in lists[: pivot + 1]:
                    move(x, nxt)
            elif lists[0][0] == item:
                score = sum(self.gains[x[2]][x[1]] for x in lists[: pivot + 1])
                if score >= threshold:
                    out.append((item, float(score)))
                for x in lists[: pivot + 1]:
                    move(x, item + 1)
            else:
                for x in lists[:pivot]:
                    if x[0] < item:
                        move(x, item)


def _overlap(part: set, there: set) -> float:
    return len(part & there) / len(part) if part else 1.0


def _search(index: Index, batch: list[str]) -> Iterator[tuple[int, int, float, float, float, float]]:
    """Row of the batch, item, score, overlap, that of the question and of the answer, of every verified pair."""
    step = max(LEAST_WINDOW, 2 * index.longest) // 2
    if not index.term:
        return
    get, docs = index.term.get, [words(text) for text in batch]
    terms = [np.fromiter((get(x, -1) for x in w), np.int64, len(w)) for w in docs]
    may = index.candidates(np.concatenate(terms), np.repeat(np.arange(len(docs)), [len(w) for w in docs]))
    unit, term, row, base = [], [], [], 0
    for d in sorted(may):
        at = np.flatnonzero(terms[d] >= 0)
        unit.append(base + at // step)
        term.append(terms[d][at])
        n = len(docs[d]) // step + 1
        row += [d] * n
        base += n
    if not may:
        return
    unit, term, row, v = np.concatenate(unit), np.concatenate(term), np.array(row), len(index.term)
    prior = unit - 1  # a passage is a unit and the next one of the same document
    ok = (prior >= 0) & (row[prior] == row[unit])
    pairs = np.unique(np.concatenate([unit, prior[ok]]) * v + np.concatenate([term, term[ok]]))
    query, term = pairs // v, pairs % v
    found: dict[tuple[int, int], float] = {}
    group = max(1, 4_000_000 // max(1, index.n_blocks))
    for s in range(0, base, group):
        i, j = np.searchsorted(query, [s, s + group])
        for q in index.bounds(query[i:j] - s, term[i:j], min(group, base - s)) + s:
            a, b = np.searchsorted(query, [q, q + 1])
            for item, score in index.wand(term[a:b].tolist()):
                key = (int(row[q]), item)
                found[key] = max(score, found.get(key, 0.0))
    for d, items in may.items():
        for item in items:
            if (d, item) not in found:
                found[d, item] = index.best(item, query, term, *np.searchsorted(row, [d, d + 1]).tolist())
    for d, hits in itertools.groupby(sorted((d, i) for d, items in may.items() for i in items), key=lambda k: k[0]):
        w = docs[d]
        by = {n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for n in range(1, WIDTH + 1)}
        for _, item in hits:
            whole, *two = (
                _overlap(p, by[len(next(iter(p)))] if p else set())
                for p in (index.shingles[item], shingles(index.parts[item][0]), shingles(index.parts[item][1]))
            )
            if whole >= OVERLAP and min(two) >= PART_OVERLAP:
                yield d, item, found[d, item], whole, two[0], two[1]


def indexes(items: DataFrame) -> Iterator[Index]:
    """The index of each block of items (item_id, text). Statistics are those of all items."""
    tests = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.col("item_id").isNotNull())

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            bag = [Counter(words(t)) for t in b.column("text").to_pylist()]
            at = np.repeat(np.arange(len(bag)), [len(x) for x in bag])
            cols = [b.column("block").take(pa.array(at)), pa.array([w for x in bag for w in x], pa.string()), pa.array([n for x in bag for n in x.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["block", "word", "tf"])

    whole = tests.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    n_blocks = max(1, -(-whole["size"] // INDEX_BYTES))
    tests = tests.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    bag = tests.select("block", "text").mapInArrow(bags, "block long, word string, tf long")
    length = bag.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    df = bag.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    for k in range(n_blocks):
        own = sorted((r["item_id"], r["text"]) for r in tests.where(F.col("block") == k).select("item_id", "text").collect())
        mine = bag.where(F.col("block") == k).select("word").distinct()
        yield Index(own, whole["n"], length / max(1, whole["n"]), {r["word"]: r["df"] for r in df.join(mine, "word").collect()})


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score (BM25 over the item's own), overlap, question_overlap, answer_overlap of each leak.

    docs: doc_id, text; items: item_id, text.
    """
    spark, d = docs.sparkSession, texts(docs)
    fields = [d.schema["doc_id"], items.schema["item_id"], *(T.StructField(c, T.DoubleType()) for c in ("score", "overlap", "question_overlap", "answer_overlap"))]
    names, out_type = [f.name for f in fields], to_arrow_type(items.schema["item_id"].dataType)
    out = spark.createDataFrame([], T.StructType(fields))
    for built in indexes(items):
        index = spark.sparkContext.broadcast(built)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", 1_000_000):
                got = list(_search(index.value, b.column("text").to_pylist()))
                if got:
                    row, item, *rest = zip(*got, strict=True)
                    ids = pa.array([index.value.ids[i] for i in item], out_type)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), ids, *(pa.array(x, pa.float64()) for x in rest)], names)

        out = out.union(d.mapInArrow(run, T.StructType(fields)))
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without a leak of items."""
    ship(docs.sparkSession)

    def free_of(index):
        def free(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            def without(part: list[str]) -> np.ndarray:
                out = np.ones(len(part), bool)
                out[[hit[0] for hit in _search(index.value, part)]] = False
                return out

            for texts_ in batches:
                yield by_slices(texts_, without, pa.bool_(), 1_000_000)

        return F.arrow_udf(free, "boolean")

    for built in indexes(items):
        docs = docs.where(free_of(docs.sparkSession.sparkContext.broadcast(built))(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return docs

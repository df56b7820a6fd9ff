"""SimHash fingerprints and their exact near-duplicate classes.

Fingerprints: words are runs of anything but ASCII white space, A-Z lower-cased; shingles are `width` words in a row,
repeats included (a shorter text is one shingle, an empty one has fingerprint zero). A bit is set if it is set in over
half of the shingles' XXH64 (seed 42).

Classes: two fingerprints link if they differ in at most `radius` bits; a class is what links reach. The search is exact.
Distinct fingerprints are compared in tiles with numpy's exclusive-or and bit count, and a tile pair whose population
counts differ by more than the radius is skipped. So that tiles which cannot match never meet, fingerprints are first
blocked: of `radius + k` bands, two within the radius agree on at least k (pigeonhole), so every choice of k bands is
a block key. k grows with the number of distinct fingerprints; any k finds every link. A block beyond BLOCK rows is cut
into parts, and each pair of parts is a task of its own. Tiles return spanning forests, never all pairs, and classes
come from alternating star contraction, so neither a hot block nor a large class lands on one task or on the driver.

Nodes are fingerprints, so rows of one doc_id and different texts stay apart and rows without a doc_id link as any other.
Null or empty texts have fingerprint zero and link like the rest. Repeated doc_ids each get their own class; a null doc_id
never names a class, and a class without any other id has none (null). An empty table has no rows.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup, slices, stage, texts

TILE = 1024
BLOCK = 8192
#: Bytes of packed text that a part of a block may hold on average, and candidate pairs between two looks at what is linked.
PART_BYTES, CONFIRM = 8_000_000, 4096
#: Distinct fingerprints that an average block may hold before one more band is asked to agree.
AVERAGE = 4096


def fingerprint(text: str, width: int = 4) -> int:
    return int(_fingerprints([text], width)[0])


def _shingles(batch: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' shingles in a row, and how many each text has."""
    digest, join, parts, counts = xxhash.xxh64_digest, b" ".join, [], []
    for text in batch:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            counts.append(0)
            continue
        line = join(words)
        if len(words) <= width:
            parts.append(digest(line, 42))
            counts.append(1)
            continue
        ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
        starts = [0, *(e + 1 for e in ends[: len(ends) - width])]
        parts += [digest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :], strict=True)]
        counts.append(len(starts))
    return np.frombuffer(b"".join(parts), ">u8").astype(np.uint64), np.array(counts, np.int64)


def _majority(hashes: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per run of hashes (starting at first, n long): the bits set in over half of them."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(sums * 2 > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprints(batch: list[str], width: int) -> np.ndarray:
    shingle, n = _shingles(batch, width)
    out, full = np.zeros(len(batch), np.uint64), np.flatnonzero(n)
    if len(full):
        out[full] = _majority(shingle, np.cumsum(n[full]) - n[full], n[full])
    return out


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long), a row for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1_000_000):
            fp = _fingerprints(b.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    d = texts(docs)
    return d.mapInArrow(run, T.StructType([d.schema["doc_id"], T.StructField("fp", T.LongType())]))


def bands(radius: int, k: int) -> list[int]:
    """Masks over 64 bits: one for each choice of k out of radius + k bands."""
    m = radius + k
    cut = [64 * i // m for i in range(m + 1)]
    one = [((1 << (cut[i + 1] - cut[i])) - 1) << cut[i] for i in range(m)]
    return [sum(one[i] for i in c) for c in itertools.combinations(range(m), k)]


def agreeing(n: int, radius: int) -> int:
    """Bands that must agree so that a block of n random fingerprints holds about AVERAGE at most."""
    k = 1
    while n / 2 ** (64 * k // (radius + k)) > AVERAGE and k < 4:
        k += 1
    return k


def _forest(fp: np.ndarray, node: np.ndarray, side: np.ndarray | None, radius: int, similar: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node it reaches) of the links among the rows of fp (uint64, a column per 64 bits).

    With side, only links between rows of different sides are looked for. With similar, rows within the radius link only
    if it holds of their places; pairs that other links join already are not tried.
    """
    pops = np.bitwise_count(fp).sum(axis=1, dtype=np.int32)
    order = np.argsort(pops, kind="stable")
    fp, node, pops = fp[order], node[order], pops[order]
    side = None if side is None else side[order]
    n, label = len(fp), np.arange(len(fp))

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = label[a], label[b]
            keep = a != b
            if not keep.any():
                return
            a, b = a[keep], b[keep]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(nxt := label[label], label):
                label[:] = nxt

    def confirmed(a: np.ndarray, b: np.ndarray) -> None:
        for s in range(0, len(a), CONFIRM):
            x, y = a[s : s + CONFIRM], b[s : s + CONFIRM]
            u, v = label[x], label[y]
            apart = u != v
            above, got = {}, []
            for p, q, c, d in zip(*(z[apart].tolist() for z in (x, y, u, v)), strict=True):
                while c in above:
                    c = above[c]
                while d in above:
                    d = above[d]
                if c != d and similar(int(order[p]), int(order[q])):
                    above[max(c, d)] = min(c, d)
                    got.append((p, q))
            if got:
                unite(*np.array(got).T)

    for i in range(0, n, TILE):
        for j in range(i, n, TILE):
            if pops[j] - pops[min(i + TILE, n) - 1] > radius:
                break
            apart = sum(np.bitwise_count(fp[i : i + TILE, None, w] ^ fp[None, j : j + TILE, w]).astype(np.uint16 if fp.shape[1] > 3 else np.uint8) for w in range(fp.shape[1]))
            hit = apart <= radius
            if side is not None:
                hit &= side[i : i + TILE, None] != side[None, j : j + TILE]
            if i == j:
                hit = np.triu(hit, 1)
            a, b = np.nonzero(hit)
            if len(a):
                (confirmed if similar else unite)(a + i, b + j)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, node)
    root = least[label]
    linked = root != node
    return node[linked], root[linked]


def _set(packed: bytes, width: int) -> np.ndarray:
    """The sorted hashes of a packed text's shingles, each once."""
    return np.unique(_shingles([zlib.decompress(packed).decode("utf-8", "surrogatepass")], width)[0])


def jaccard_reaches(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted, each element once) have that Jaccard similarity at least."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _compare(radius: int, words: int, width: int = 0, similarity: float = 0.0):
    columns = ("block", "key", "lo", "hi", "part", "node", *(f"f{w}" for w in range(words)), *(("packed",) if width else ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by their block; a block may run over several batches."""
        held: list[tuple] = []
        at = None

        def close() -> tuple[np.ndarray, np.ndarray]:
            part, node, *fp = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(node) < 2:
                return node[:0], node[:0]
            side = None if (part == part[0]).all() else part
            similar = None
            if width:
                packed, sets = fp.pop(), {}

                def of(k: int) -> np.ndarray:
                    if k not in sets:
                        sets[k] = _set(packed[k], width)
                    return sets[k]

                similar = lambda p, q: jaccard_reaches(of(p), of(q), similarity)
            return _forest(np.stack(fp, axis=1).view(np.uint64), node, side, radius, similar)

        def edges(pairs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*pairs, strict=True)], ["src", "dst"])

        for b in batches:
            block, key, lo, hi, *rest = (b.column(c).to_numpy(zero_copy_only=False) for c in columns)
            if not len(key):
                continue
            new = np.flatnonzero((block[1:] != block[:-1]) | (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            found, cuts = [], [0, *new.tolist(), len(key)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                here = (block[s], key[s], lo[s], hi[s])
                if at is not None and here != at:
                    found.append(close())
                    held = []
                at = here
                held.append(tuple(x[s:e] for x in rest))
            if found:
                yield edges(found)
        if held:
            yield edges([close()])

    return run


def links(nodes: DataFrame, blocks: Column, words: int, radius: int, packed: DataFrame | None = None, width: int = 0, similarity: float = 0.0) -> DataFrame:
    """Edges (src, dst) that span the classes of nodes (node: distinct longs; f0, f1 ...: the fingerprint).

    blocks: an array of longs; two nodes are compared if some element, at the same place, is equal. With packed (node,
    packed: its text, zlib-compressed), nodes within the radius link only if the sets of their texts' shingles of `width`
    words have that Jaccard similarity; nodes then has size, the bytes of packed.
    """
    prints = [f"f{w}" for w in range(words)]
    weight = F.lit(0) if packed is None else F.col("size")
    keyed = nodes.select("node", *prints, weight.alias("size"), F.posexplode(blocks).alias("block", "key"))
    size = keyed.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where(F.col("n") > 1)
    cut = (
        keyed.drop("size").join(size, ["block", "key"])
        .withColumn("parts", F.greatest(F.ceil(F.col("n") / F.lit(BLOCK)), F.ceil(F.col("bytes") / F.lit(PART_BYTES))).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64(*prints), F.col("parts")).cast("int"))
        .withColumn("pair", F.explode(F.expr("transform(sequence(0, parts - 1), q -> struct(least(q, part) AS lo, greatest(q, part) AS hi))")))
        .select("block", "key", "pair.lo", "pair.hi", "part", "node", *prints)
    )
    if packed is not None:
        cut = cut.join(packed, "node")
    tasks = cut.repartition("block", "key", "lo", "hi").sortWithinPartitions("block", "key", "lo", "hi")
    return tasks.mapInArrow(_compare(radius, words, width, similarity), "src long, dst long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reached) of every node that an edge (src, dst) touches.

    Alternates large-star and small-star contraction until nothing changes; each round is a written table.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        """Hangs each node's larger (large) or smaller neighbours on the least of its neighbours and itself. n: how many edges e has."""
        near = both(e) if large else e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = near.groupBy("src").agg(F.min("dst").alias("low"), F.count(F.lit(1)).alias("n")).select("src", F.least("src", "low").alias("low"), "n")
        hung = lookup(near, low, "src", "n", 2 * n if large else n)
        if large:
            out = hung.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        else:
            out = hung.select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(low.select("src", F.col("low").alias("dst")))
        return out.where("src != dst").distinct()

    now = stage(edges.where("src != dst").distinct(), "edges")
    n, seen = now.count(), None
    while n:
        now = stage(star(now, True, n), "stars")
        now = stage(star(now, False, now.count()), "stars")
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst")), F.sum(F.xxhash64("src", "dst") % 1_000_003)).first()
        if mark == seen:
            break
        n, seen = mark[0], mark
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(
        now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )


def classes(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp and component_id (least doc_id in the class) for each row of docs (doc_id, text)."""
    prints = stage(fingerprints(docs, width), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    whole = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    masks = [m - (1 << 64) if m >> 63 else m for m in bands(radius, agreeing(whole[0], radius))]
    blocks = F.array(*[F.col("f0").bitwiseAND(F.lit(m).cast("long")) for m in masks])
    found = components(links(nodes.select(F.col("fp").alias("node"), F.col("fp").alias("f0")), blocks, 1, radius))
    named = stage(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("class")), "classes")
    by_class = named.groupBy("class").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    told = stage(lookup(named, by_class, "class", "members", whole[0]).select("fp", "n", "component_id"), "named")
    return lookup(prints, told, "fp", "n", whole[1]).select("doc_id", "fp", "component_id")


#: 64-bit fingerprints that the estimate of a similarity rests on, and the min-wise keys of two hashes that block it.
WORDS, KEYS = 4, 6
#: Standard errors that a candidate's fingerprint may be farther away than the similarity has it: by the binomial law one
#: pair in a hundred million is lost; sets of a few shingles vary more (4 and 5 of them differ in 48 bits, not 39).
ERRORS = 6
_DRAW = np.random.default_rng(3).integers(1, 1 << 62, 2 * KEYS + WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bits_apart(similarity: float, words: int = WORDS) -> int:
    """Bits in which fingerprints of that Jaccard similarity differ on average, and ERRORS standard errors more."""
    n = 64 * words
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(n * p + ERRORS * math.sqrt(n * p * (1 - p)))


def _sketches(batch: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's set of shingles: WORDS fingerprints (the hashes mixed anew for each), KEYS min-wise keys and a hash of the set."""
    shingle, n = _shingles(batch, width)
    prints, keys, sets = np.zeros((len(batch), WORDS), np.uint64), np.zeros((len(batch), KEYS), np.uint64), np.zeros((len(batch), 1), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        row = np.repeat(np.arange(len(batch)), n)
        order = np.lexsort((shingle, row))
        shingle, row = shingle[order], row[order]
        once = np.append(True, (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1]))
        shingle, n = shingle[once], np.bincount(row[once], minlength=len(batch))
        first = np.cumsum(n[full]) - n[full]
        for w in range(WORDS):
            mixed = (shingle ^ (shingle >> np.uint64(29))) * _DRAW[w]
            prints[full, w] = _majority(mixed ^ (mixed >> np.uint64(32)), first, n[full])
        for k in range(KEYS):
            low = [np.minimum.reduceat((shingle ^ (shingle >> np.uint64(31))) * _DRAW[WORDS + 2 * k + i], first) for i in (0, 1)]
            keys[full, k] = low[0] * np.uint64(0x9E3779B97F4A7C15) ^ low[1]
        sets[full, 0] = [xxhash.xxh64_intdigest(shingle[a : a + m].tobytes(), 42) for a, m in zip(first.tolist(), n[full].tolist(), strict=True)]
    return prints, keys, sets


def distinct(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, all columns, with one row of each near-duplicate class: that of the least doc_id, then of the least text hash.

    Similarity is the Jaccard similarity of the sets of `width`-word shingles. Texts of one set (by its 64-bit hash) are one
    node; nodes whose 64 * WORDS fingerprint bits estimate a near similarity are candidates, and a candidate pair links only
    if its sets really have that similarity. At the radius this takes, bands of a fingerprint are too short to block by, so
    blocks are of texts that agree in one of KEYS min-wise keys of two shingles each: of pairs at 0.8 that is 99.8 in a
    hundred, more above. Tiles within blocks are compared and skipped as in classes(). Each block holds its texts packed,
    and is cut into more parts where they are long.
    """
    d = texts(docs).select("doc_id", F.xxhash64("text").alias("t"), "text")
    names = [*(f"f{w}" for w in range(WORDS)), *(f"k{k}" for k in range(KEYS))]
    more = ("t", *names, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1_000_000):
            batch = b.column("text").to_pylist()
            made = np.concatenate(_sketches(batch, width), axis=1).view(np.int64)
            packed = pa.array([zlib.compress(x.encode("utf-8", "surrogatepass"), 1) for x in batch], pa.binary())
            cols = [b.column("doc_id"), b.column("t"), *(pa.array(np.ascontiguousarray(made[:, i])) for i in range(made.shape[1])), packed]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *more, "packed"])

    schema = T.StructType([d.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in more), T.StructField("packed", T.BinaryType())])
    rows = stage(d.mapInArrow(run, schema), "sketches")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t"))
    size = F.max(F.octet_length("packed")).alias("size")
    nodes = stage(rows.groupBy("node").agg(*(F.first(x).alias(x) for x in names), best.alias("best"), size, F.count(F.lit(1)).alias("n")), "nodes")
    whole = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    packed = rows.select("node", "packed").dropDuplicates(["node"])  # of texts with one set of shingles any will do
    found = components(links(nodes, F.array(*names[WORDS:]), WORDS, bits_apart(similarity), packed, width, similarity))
    named = stage(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("class"), "best", "n"), "classes")
    keep = named.groupBy("class").agg(F.min("best").alias("keep"), F.count(F.lit(1)).alias("members"))
    kept = stage(lookup(named, keep, "class", "members", whole[0]).select("node", "keep", "n"), "kept")
    other = ~(F.col("keep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keep.t") == F.col("t")))
    drop = lookup(rows.select("doc_id", "t", "node"), kept, "node", "n", whole[1]).where(other).select(F.xxhash64("doc_id", "t").alias("key"), "t")
    # one exchange of whole rows, by keys that are never null: of equal rows the first stays, then those to drop go
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", F.xxhash64(text)).alias("key"), F.xxhash64(text).alias("t"))
    first = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("key", "t").orderBy("t"))).where("nth = 1")
    return first.join(drop.distinct(), ["key", "t"], "left_anti").select("row.*")

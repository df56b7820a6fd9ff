"""Sharding by best-fit-decreasing bin packing.

Indivisible groups, sorted by size, each enter the shard with the tightest remaining capacity that holds them, found in a
balanced tree. The capacity is the least (up to a step of 2^k * STEP) at which the groups fill no more than the shards
wanted, so their sizes come out near equal. A group beyond an even share has a shard to itself, and the rest is shared out anew.

Every group is packed. Groups of one size are alike, so the driver packs the histogram of sizes: the tightest shard takes
groups of a size for as long as it has room (it stays the tightest), then the next does. Each group finds its shard by its
rank among those of its size. Distinct sizes number at most the square root of twice all bytes, however many groups there are.

Null texts count as empty; equal texts form a group; texts of equal 64-bit hash would share one, which splits none.
Repeated rows are sharded as often as they occur; an empty table has no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, ranked, stage, texts

STEP = 2e-5
OVERHEAD = 16


class Tree:
    """A treap of distinct keys (remaining capacity, shard): insert, delete, and the least key at or above one."""

    def __init__(self) -> None:
        self.root, self.draw = None, random.Random(5).random

    def _split(self, node, key):
        """Keys below key, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = self._split(node[2], key)
            return node, right
        left, node[1] = self._split(node[1], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[3] > b[3]:
            a[2] = self._merge(a[2], b)
            return a
        b[1] = self._merge(a, b[1])
        return b

    def insert(self, key) -> None:
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, [key, None, None, self.draw()]), b)

    def take_at_least(self, key):
        """Removes and returns the least key at or above key; None if there is none."""
        node, best = self.root, None
        while node is not None:
            if node[0] >= key:
                best, node = node[0], node[1]
            else:
                node = node[2]
        if best is not None:
            a, b = self._split(self.root, best)
            _, b = self._split(b, (best[0], best[1] + 1))
            self.root = self._merge(a, b)
        return best


def fill(counts: list[tuple[int, int]], capacity: int, most: int) -> list[tuple[int, int, int]] | None:
    """Best-fit decreasing of (size, how many), sizes descending, into bins of the capacity: runs (size, how many, bin); None beyond `most` bins."""
    tree, bins, out = Tree(), 0, []
    for size, left in counts:
        while left:
            got = tree.take_at_least((size, -1))
            if got is None:
                if bins == most:
                    return None
                got = (capacity, bins)
                bins += 1
            n = min(left, got[0] // size)
            out.append((size, n, got[1]))
            tree.insert((got[0] - n * size, got[1]))
            left -= n
    return out


def share_out(counts: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Runs (size, how many, shard) of (size > 0, how many), sizes descending."""
    rest, out, left, total = [list(c) for c in counts if c[1]], [], shards, sum(s * n for s, n in counts)
    while rest and left > 1 and rest[0][0] * left >= total:
        out.append((rest[0][0], 1, shards - left))
        total -= rest[0][0]
        left -= 1
        rest[0][1] -= 1
        if not rest[0][1]:
            rest.pop(0)
    step = 0.0
    while rest:
        got = fill([tuple(r) for r in rest], max(rest[0][0], int(-(-total // left) * (1 + step))), left)
        if got is not None:
            return out + [(s, n, shards - left + b) for s, n, b in got]
        step = step * 2 or STEP
    return out


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 16), text_crc32, shard and slot (gapless from 0 in each shard) of docs (doc_id, text)."""
    rows = stage(
        texts(docs).select(
            "doc_id", (F.octet_length("text") + OVERHEAD).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.xxhash64("text").alias("h")
        ),
        "digests",
    )
    n = rows.count()
    groups = stage(rows.groupBy("h").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "groups")
    histogram = groups.groupBy("size").agg(F.count(F.lit(1)).alias("groups")).toArrow().sort_by([("size", "descending")])
    runs = np.array(share_out(list(zip(*(histogram.column(c).to_pylist() for c in ("size", "groups")), strict=True)), shards), np.int64).reshape(-1, 3)
    runs = runs[np.argsort(-runs[:, 0], kind="stable")]
    sizes, first = np.unique(-runs[:, 0], return_index=True)
    begin = np.cumsum(runs[:, 1]) - runs[:, 1]  # the place of each run's first group among all, by size and then rank
    plan = docs.sparkSession.sparkContext.broadcast((sizes, begin[first], begin, runs[:, 2].astype(np.int32)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, base, begin, where = plan.value
        for b in batches:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("size", "rank"))
            at = base[np.searchsorted(sizes, -size)] + rank
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("n"), pa.array(where[np.searchsorted(begin, at, side="right") - 1])], ["h", "n", "shard"])

    put = ranked(groups, ["size"], ["h"], n).select("h", "n", "size", "rank").mapInArrow(place, "h long, n long, shard int")
    placed = lookup(rows, stage(put, "shards"), "h", "n", n).drop("h")
    return ranked(placed, ["shard"], ["doc_id", "text_crc32", "size"], n).withColumnRenamed("rank", "slot")

"""Interpolated modified Kneser-Ney trigram model, counted in Spark and kept as sorted hash arrays that workers memory-map.

Tokens are the words of a text (runs of anything but ASCII white space, A-Z lower-cased) and then one end. Words are 48-bit
hashes (a polynomial over random byte values, mixed). A text's first token has the start as its only context, the second
the start and the first, every other the two tokens before it. With a(vw) the number of distinct tokens before the pair vw
(its count, if v is the start), a(w) that of distinct tokens before w, and D, E, G the three discounts of 1, 2 and 3+,

    p(w|uv) = max(c(uvw) - D(c(uvw)), 0) / c(uv.) + d(uv) p(w|v),
    p(w|v)  = max(a(vw) - E(a(vw)), 0) / a(v.) + e(v) p(w),       p(w) = max(a(w) - G(a(w)), 0) / a(.) + g / (V + 1),

d, e and g being what the discounts free, V the number of distinct training tokens: p sums to 1 over them and one unknown.

Counting: tasks count trigrams in buffers and send each bucket one compressed block of them. Buckets are by the middle word,
so the trigrams, the contexts uv and the pairs vw of a bucket are all counted in one task and written as sorted arrays; only
counts by word go on, merged the same way. Middle words that a sample finds too frequent for a bucket are spread over all
of them by the first word, and their pairs, partly counted, are merged by pair in a step of their own (the sample decides
where things are counted, never what). The number of buckets follows the input, so a task's share stays the same. Files go
to the folder in spark.checkpoint.dir, which must be mounted (a file: URI) on all workers, under a temporary name first, so
a repeated task replaces a file by an equal one; a file that is missing later raises.

In a bucket, keys are 40 bits of a hash: about one in a million unseen trigrams is taken for a seen one. Of contexts, those
that occur twice or more are written; one that has only its pair has occurred once.

Null or empty texts are one end token. Repeated rows count and score as often as they occur. Without training rows every
token scores as unknown.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path, slices, stage, texts

#: Trigrams a task counts before it sends them on.
BUFFER = 2_400_000
#: Bytes of text a bucket stands for.
BUCKET_BYTES = 10_000_000
#: Share of rows sampled for frequent words, and the most of these.
HOT_SAMPLE, HOT_MOST = 0.01, 200_000
END, START, BEFORE = 1, 2, 3
_LOW = np.uint64((1 << 48) - 1)
_BASE = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text hashed at a time.
_CHUNK = 2_000_000


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(_BASE)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """The base's powers and their inverses, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(n, b % (1 << 64), np.uint64))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def _words(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the bytes and where it begins; no word runs over a place in cut."""
    word = np.append(~_BLANK[data], False)
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[cut] |= word[cut]
    last = word[:-1] & (~word[1:] | first[1:])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(len(data) + 1)
    total = np.append(np.uint64(0), np.cumsum(_VALUE[data] * up[: len(data)]))
    h = _mix((total[end] - total[start]) * down[start], (end - start).astype(np.uint64)) & _LOW
    return h + np.uint64(16) * (h < 16), start


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of an array of strings without nulls, each string's closed by END, and how many each has."""
    size = np.frombuffer(column.buffers()[1], np.int32 if column.type == pa.string() else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[size[0] : size[-1]]
    size = size - size[0]
    found, at, begin = [], [], 0
    while begin < len(data):
        end = begin + _CHUNK
        while end < len(data) and not _BLANK[data[end]]:
            gap = np.flatnonzero(_BLANK[data[end : end + 4096]])
            end += int(gap[0]) if len(gap) else 4096
        cut = size[np.searchsorted(size, begin) : np.searchsorted(size, end)] - begin
        h, s = _words(data[begin:end], cut[cut < min(end, len(data)) - begin])
        found.append(h)
        at.append(s + begin)
        begin = end
    words, place = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((found, np.uint64), (at, np.int64)))
    row = np.searchsorted(size, place, side="right") - 1
    n = np.bincount(row, minlength=len(column)) + 1
    out = np.full(len(words) + len(column), END, np.uint64)
    out[np.arange(len(words)) + row] = words
    return out, n


def _before(x: np.ndarray, first: np.ndarray, start: int, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each place the value two before and that one before, within rows that begin at first."""
    v = np.empty_like(x)
    v[1:], v[first] = x[:-1], start
    u = np.empty_like(x)
    u[1:], u[first] = v[:-1], before
    return u, v


def _bucket(v: np.ndarray, other: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of middle words v, spread by the other word where v is hot, and whether it is. hot is never empty."""
    spread = hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v
    at = np.where(spread, _mix(v, other), _mix(v, np.zeros(1, np.uint64)))
    return (at % np.uint64(buckets)).astype(np.int64), spread


def _planes(column: np.ndarray, k: int) -> bytes:
    """The k low bytes of numbers, in planes, so that equal leading bytes lie together."""
    return np.ascontiguousarray(column.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes()


def _unplanes(raw: np.ndarray, n: int, k: int) -> np.ndarray:
    full = np.zeros((n, 8), np.uint8)
    full[:, :k] = raw.reshape(k, n).T
    return full.view("<u8").ravel()


def _squeeze(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of unsigned numbers, each with the bytes it takes, compressed."""
    head = np.array([x for c, k in columns for x in (len(c), k)], "<i8").tobytes()
    return len(columns).to_bytes(8, "little") + head + pa.compress(b"".join(_planes(c, k) for c, k in columns), codec="zstd", asbytes=True)


def _expand(blob: bytes) -> list[np.ndarray]:
    count = int.from_bytes(blob[:8], "little")
    shape = np.frombuffer(blob[8 : 8 + 16 * count], "<i8").reshape(-1, 2).tolist()
    raw = np.frombuffer(pa.decompress(blob[8 + 16 * count :], decompressed_size=sum(n * k for n, k in shape), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for n, k in shape:
        out.append(_unplanes(raw[at : at + n * k], n, k))
        at += n * k
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination starts in columns sorted together."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _spans(key: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal keys begins and ends."""
    cut = _runs(key).tolist()
    return list(zip(cut, [*cut[1:], len(key)][: len(cut)], strict=True))


def _sums(at: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    return [np.add.reduceat(c, at) if len(at) else c[:0] for c in columns]


def _table(name: str, key: np.ndarray, *columns: np.ndarray) -> dict[str, np.ndarray]:
    """Rows by 40 bits of key, sorted: 32 bits and 8. Keys of the most usual row are apart; others have their place among the distinct rows."""
    key = key >> np.uint64(24)
    if len(columns) == 1:
        rows, place, n = np.unique(columns[0], return_inverse=True, return_counts=True)
        rows = rows[:, None]
    else:
        rows, place, n = np.unique(np.stack(columns, axis=1), axis=0, return_inverse=True, return_counts=True)
    kind = np.uint8 if len(rows) < 1 << 8 else np.uint16 if len(rows) < 1 << 16 else np.uint32
    place, usual, out = place.ravel().astype(kind), int(n.argmax()) if len(n) else 0, {f"{name}.rows": rows.astype(np.int64)}
    out[f"{name}.usual"] = out[f"{name}.rows"][usual : usual + 1]
    for part, at in (("usual", np.flatnonzero(place == usual)), ("other", np.flatnonzero(place != usual))):
        at = at[np.argsort(key[at])]
        out |= {f"{name}.{part}.high": (key[at] >> np.uint64(8)).astype(np.uint32), f"{name}.{part}.low": key[at].astype(np.uint8)}
        if part == "other":
            out[f"{name}.row"] = place[at]
    return out


def _write(path: str, table: dict[str, np.ndarray]) -> None:
    """One file: its head's length, the head (where each array lies), the arrays."""
    head, parts, at = {}, [], 0
    for name, array in table.items():
        head[name] = (at, array.dtype.str, array.shape)
        parts.append(np.ascontiguousarray(array).tobytes() + bytes(-array.nbytes % 8))
        at += len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    temporary = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
    with open(temporary, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        f.writelines(parts)
    os.replace(temporary, path)


def _mapped(path: str) -> dict[str, np.ndarray]:
    raw = np.memmap(path, np.uint8, "r")
    base = 8 + int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8:base].tobytes())
    return {k: np.ndarray(shape, kind, raw, base + at) for k, (at, kind, shape) in head.items()}


def _discounts(n: list[int]) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return (0.5, 1.0, 1.5) if n1 else (0.0, 0.0, 0.0)
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0
    return tuple(min(max(x, 0.0), k) for k, x in enumerate(d, 1))


@dataclass
class Model:
    """path: the folder of the files; written: by kind of file, the buckets that have one; discounts: of trigrams, pairs, words."""

    path: str
    buckets: int
    hot: np.ndarray
    tokens: int
    distinct: int
    continuations: int
    discounts: tuple[tuple[float, float, float], ...]
    freed: float
    written: dict[str, np.ndarray] = field(default_factory=dict)

    def scorer(self) -> _Scorer:
        return _Scorer(self)


def _places(highs: np.ndarray, lows: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Where each sorted key lies among the sorted keys (highs, lows); -1 where it doesn't."""
    out = np.full(len(high), -1, np.int64)
    if not len(highs):
        return out
    place = np.minimum(np.searchsorted(highs, high), len(highs) - 1)
    left = np.flatnonzero(highs[place] == high)
    while len(left):  # keys of equal high bits lie in a row
        at = place[left]
        hit = lows[at] == low[left]
        out[left[hit]] = at[hit]
        left = left[~hit]
        place[left] += 1
        left = left[place[left] < len(highs)]
        left = left[highs[place[left]] == high[left]]
    return out


class _Scorer:
    """Looks trigrams, contexts, pairs and words up in the mapped arrays."""

    def __init__(self, model: Model):
        self.m, self.open = model, {}
        self.d, self.e, self.g = (np.array([0.0, *x]) for x in model.discounts)

    def _map(self, kind: str, bucket: int) -> dict[str, np.ndarray] | None:
        key = (kind, bucket)
        if key not in self.open:
            if len(self.open) > 4000:
                self.open.clear()
            have = self.m.written[kind]
            i = int(np.searchsorted(have, bucket))
            self.open[key] = _mapped(f"{self.m.path}/{bucket}.{kind}") if i < len(have) and have[i] == bucket else None
        return self.open[key]

    def find(self, kind: str, table: str, bucket: np.ndarray, key: np.ndarray, columns: int) -> np.ndarray:
        """The row at each key, a column each; zeros where it is absent. Keys are looked up in order, so reads are near each other."""
        out = np.zeros((columns, len(key)), np.int64)
        key = key >> np.uint64(24)
        order = np.argsort(bucket.astype(np.uint64) << np.uint64(40) | key) if self.m.buckets < 1 << 24 else np.lexsort((key, bucket))
        bucket, key = bucket[order], key[order]
        high, low = (key >> np.uint64(8)).astype(np.uint32), key.astype(np.uint8)
        for s, e in _spans(bucket):
            have = self._map(kind, int(bucket[s]))
            if have is None:
                continue
            to = order[s:e]
            left = np.arange(e - s)
            for part in ("other", "usual"):
                place = _places(have[f"{table}.{part}.high"], have[f"{table}.{part}.low"], high[s:e][left], low[s:e][left])
                hit = place >= 0
                rows = have[f"{table}.usual"] if part == "usual" else have[f"{table}.rows"][have[f"{table}.row"][place[hit]]]
                out[:, to[left[hit]]] = rows.T
                left = left[~hit]
        return out

    def __call__(self, token: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's log10 probability, base log10 probability, and training count."""
        m, first = self.m, np.cumsum(n) - n
        word, back = np.unique(np.append(token, np.uint64(START)), return_inverse=True)
        stats = self.find("words", "word", (_mix(word, np.ones(1, np.uint64)) % np.uint64(m.buckets)).astype(np.int64), _mix(word, word), 6)
        _, v_row = _before(back[:-1], first, back[-1], back[-1])
        u, v = _before(token, first, START, BEFORE)
        count, contexts = stats[0][back[:-1]], stats[1][back[:-1]]
        unknown = m.freed / (m.distinct + 1)
        p = (np.maximum(contexts - self.g[np.minimum(contexts, 3)], 0) / m.continuations if m.continuations else 0.0) + unknown

        bucket, spread = _bucket(v, token, m.hot, m.buckets)
        pair, key = np.zeros(len(token), np.int64), _mix(v, token)
        for kind, rows in (("hot", np.flatnonzero(spread)), ("main", np.flatnonzero(~spread))):
            pair[rows] = self.find(kind, "pair", bucket[rows], key[rows], 1)[0]
        total, one, two, more = (stats[k][v_row] for k in (2, 3, 4, 5))
        free = self.e[1] * one + self.e[2] * two + self.e[3] * more
        seen = np.maximum(total, 1)
        p = np.where(total > 0, np.maximum(pair - self.e[np.minimum(pair, 3)], 0) / seen + free / seen * p, p)

        inner = np.ones(len(token), bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        known = pair[at - 1] > 0  # the pair before is this token's context
        at = at[known]
        bucket, _ = _bucket(v[at], u[at], m.hot, m.buckets)
        context = _mix(u[at], v[at])
        total, one, two, more = self.find("main", "context", bucket, context, 4)
        one += total == 0
        total = np.maximum(total, 1)
        (c,) = self.find("main", "trigram", bucket, _mix(context, token[at]), 1)
        free = self.d[1] * one + self.d[2] * two + self.d[3] * more
        p[at] = np.maximum(c - self.d[np.minimum(c, 3)], 0) / total + free / total * p[at]
        return np.log10(p), np.log10((count + 1) / (m.tokens + m.distinct + 1)), count


def hot_words(train: DataFrame, buckets: int) -> np.ndarray:
    """The start, and hashes of the words that in a sample make up a bucket's share of the tokens or more; sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            u, c = np.unique(tokens(b.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(c)], ["u", "c"])

    seen = stage(train.select("text").sample(HOT_SAMPLE, 11).mapInArrow(run, "u long, c long").groupBy("u").agg(F.sum("c").alias("c")), "frequent-words")
    least = max(1 / buckets, 1 / HOT_MOST) * (seen.agg(F.sum("c")).first()[0] or 0)
    top = seen.where(F.col("c") >= least).orderBy(F.col("c").desc(), "u").limit(HOT_MOST).select("u").toArrow()
    return np.unique(np.append(top.column("u").to_numpy(), START)).astype(np.uint64)


def _blocks(bucket: np.ndarray, kind: int, columns: list[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    """A row (kind, bucket, blob) for each run of equal buckets."""
    spans = _spans(bucket)
    cut = [s for s, _ in spans]
    blobs = [_squeeze(*((c[s:e], k) for c, k in columns)) for s, e in spans]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), kind, np.int32)), pa.array(bucket[cut].astype(np.int32)), pa.array(blobs, pa.binary())], ["kind", "bucket", "blob"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blobs of each bucket, of rows sorted by it."""
    at, blobs = None, []
    for b in batches:
        for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist(), strict=True):
            if bucket != at and blobs:
                yield at, blobs
                blobs = []
            at = bucket
            blobs.append(blob)
    if blobs:
        yield at, blobs


_SUMS = ["n1", "n2", "n3", "n4", "m1", "m2", "m3", "m4", "l1", "l2", "l3", "l4", "tokens", "distinct", "continuations"]


def _summary(bucket: int, **values: list[int]) -> pa.RecordBatch:
    """A row of kind 2: sums for the driver, and the bucket as one that has a file."""
    given = {f"{k}{i}": x for k, v in values.items() if len(v) == 4 for i, x in enumerate(v, 1)} | {k: v[0] for k, v in values.items() if len(v) == 1}
    blob = np.array([given.get(k, 0) for k in _SUMS], "<i8").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["kind", "bucket", "blob"])


def _few(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def _of_pairs(v: np.ndarray, w: np.ndarray, a: np.ndarray, counted: np.ndarray, count: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of complete pairs vw with a(vw), and of words with their counts: the words' statistics, to their buckets."""
    order = np.argsort(v)
    sv = _runs(v[order])
    by_v = [v[order][sv], *_sums(sv, a[order], *((x[order]).astype(np.int64) for x in (a == 1, a == 2, a > 2)))]
    words = np.concatenate([counted, w, by_v[0]])
    part = [len(counted), len(w), len(sv)]
    columns = [np.zeros(sum(part), np.int64) for _ in range(6)]  # count, contexts, followed, one, two, more
    columns[0][: part[0]] = count
    columns[1][part[0] : part[0] + part[1]] = 1
    for c, x in zip(columns[2:], by_v[1:], strict=True):
        c[part[0] + part[1] :] = x
    order = np.argsort(words)
    at = _runs(words[order])
    words, columns = words[order][at], _sums(at, *(c[order] for c in columns))
    bucket = (_mix(words, np.ones(1, np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    yield from _blocks(bucket[order], 1, [(words[order], 6), *((c[order], 8) for c in columns)])


def fit(train: DataFrame) -> Model:
    """The model of the texts of train (text)."""
    train = texts(train)
    size = train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // BUCKET_BYTES))
    hot = hot_words(train, buckets)
    path = shared_path(train.sparkSession, "kneser-ney")
    if not path.startswith(("file:", "/")):
        raise ValueError(f"the model's arrays are memory-mapped: spark.checkpoint.dir must be a mounted folder, not {path}")
    path = "/" + path.removeprefix("file:").lstrip("/")
    os.makedirs(path, exist_ok=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            token, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            word, ids = np.unique(np.append(token, np.array([START, BEFORE], np.uint64)), return_inverse=True)
            w = ids[:-2].astype(np.int32)
            u, v = _before(w, np.cumsum(n) - n, int(ids[-2]), int(ids[-1]))
            starts = v == ids[-2]
            bucket, _ = _bucket(word[v], word[np.where(starts, w, u)], hot, buckets)
            del token, ids, starts
            order = np.lexsort((w, (bucket * len(word) + v) * len(word) + u)) if buckets * len(word) ** 2 < 1 << 62 else np.lexsort((w, u, v, bucket))
            u, v, w, bucket = u[order], v[order], w[order], bucket[order]
            at = _runs(bucket, v, u, w)
            c = np.diff(at, append=len(u))
            u, v, w, bucket = u[at], v[at], w[at], bucket[at]
            spans, blobs = _spans(bucket), []
            for s, e in spans:
                here = np.zeros(len(word), bool)
                for x in (u, v, w):
                    here[x[s:e]] = True
                new, used = np.cumsum(here) - 1, np.flatnonzero(here)
                own = [new[x[s:e]] for x in (u, v, w)]
                blobs.append(_squeeze((np.diff(word[used], prepend=np.uint64(0)), 6), (own[0], 4), (np.diff(own[1], prepend=0), 4), (own[2], 4), (c[s:e], 4)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[[s for s, _ in spans]].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for b in slices(batches, "text"):
            held.append(tokens(b.column("text")))
            size += len(held[-1][0])
            if size >= BUFFER:
                yield from send()
                size = 0
        if held:
            yield from send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _by_bucket(batches):
            u, v, w, c = (np.concatenate(x) for x in zip(*map(_trigrams, blobs), strict=True))
            key = _mix(_mix(u, v), w)
            order = np.argsort(key)
            at = _runs(key[order])
            (c,) = _sums(at, c[order].astype(np.int64))
            order = order[at]
            u, v, w, key = u[order], v[order], w[order], key[order]
            order = np.argsort(w)
            at = _runs(w[order])
            counted, (count_,) = w[order][at], _sums(at, c[order])
            starts = v == START
            rest = np.flatnonzero(~starts)
            context = _mix(u[rest], v[rest])
            order = np.argsort(context)
            at = _runs(context[order])
            often = _sums(at, *(x[rest][order].astype(np.int64) for x in (c, c == 1, c == 2, c > 2)))
            twice = np.flatnonzero(often[0] > 1)
            tables = _table("trigram", key[rest], c[rest]) | _table("context", context[order][at][twice], *(x[twice] for x in often))
            few = _few(c[rest])
            del key, context, rest, often
            pair = _mix(v, w)
            order = np.argsort(pair)
            at = _runs(pair[order])
            (a,) = _sums(at, np.where(starts, c, 1)[order])
            v, w, pair = v[order][at], w[order][at], pair[order][at]
            spread = _bucket(v, w, hot, buckets)[1]
            whole = np.flatnonzero(~spread)
            _write(f"{path}/{bucket}.main", tables | _table("pair", pair[whole], a[whole]))
            del tables, pair, u, c
            yield _summary(bucket, n=few, m=_few(a[whole]))
            yield from _of_pairs(v[whole], w[whole], a[whole], counted, count_, buckets)
            part = np.flatnonzero(spread)
            to, _ = _bucket(v[part], w[part], hot, buckets)
            order = np.lexsort((w[part], v[part], to))
            part = part[order]
            yield from _blocks(to[order], 0, [(v[part], 6), (w[part], 6), (a[part], 8)])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _by_bucket(batches):
            v, w, a = (np.concatenate(x) for x in zip(*map(_expand, blobs), strict=True))
            pair = _mix(v, w)
            order = np.argsort(pair)
            at = _runs(pair[order])
            (a,) = _sums(at, a[order].astype(np.int64))
            v, w, pair = v[order][at], w[order][at], pair[order][at]
            _write(f"{path}/{bucket}.hot", _table("pair", pair, a))
            yield _summary(bucket, m=_few(a))
            yield from _of_pairs(v, w, a, w[:0], a[:0], buckets)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _by_bucket(batches):
            word, *columns = (np.concatenate(x) for x in zip(*map(_expand, blobs), strict=True))
            order = np.argsort(word)
            at = _runs(word[order])
            word, columns = word[order][at], _sums(at, *(x[order].astype(np.int64) for x in columns))
            _write(f"{path}/{bucket}.words", _table("word", _mix(word, word), *columns))
            yield _summary(bucket, l=_few(columns[1]), tokens=[int(columns[0].sum())], distinct=[int((columns[0] > 0).sum())], continuations=[int(columns[1].sum())])

    out = "kind int, bucket int, blob binary"

    def spread(df: DataFrame) -> DataFrame:
        return df.select("bucket", "blob").repartition(3 * buckets, "bucket").sortWithinPartitions("bucket")

    merged = stage(spread(train.mapInArrow(count, "bucket int, blob binary")).mapInArrow(merge, out), "kneser-ney-merged")
    spread_pairs = stage(spread(merged.where("kind = 0")).mapInArrow(pairs, out), "kneser-ney-pairs")
    by_word = merged.where("kind = 1").union(spread_pairs.where("kind = 1"))
    sums = stage(spread(by_word).mapInArrow(words, out), "kneser-ney-sums")
    written, got = {}, np.zeros(len(_SUMS), np.int64)
    for kind, df in (("main", merged), ("hot", spread_pairs), ("words", sums)):
        rows = df.where("kind = 2").select("bucket", "blob").toArrow()  # one a bucket
        written[kind] = np.sort(rows.column("bucket").to_numpy())
        got += sum((np.frombuffer(b, "<i8") for b in rows.column("blob").to_pylist()), np.zeros(len(_SUMS), np.int64))
    sum_of = dict(zip(_SUMS, got.tolist(), strict=True))
    d, e, g = (_discounts([sum_of[f"{k}{i}"] for i in range(1, 5)]) for k in "nml")
    a, ones = sum_of["continuations"], [sum_of[f"l{i}"] for i in range(1, 5)]
    freed = (g[0] * ones[0] + g[1] * ones[1] + g[2] * (sum_of["distinct"] - ones[0] - ones[1])) / a if a else 1.0
    return Model(path, buckets, hot, sum_of["tokens"], sum_of["distinct"], a, (d, e, g), freed, written)


def _trigrams(blob: bytes) -> tuple[np.ndarray, ...]:
    word, u, v, w, c = _expand(blob)
    word = np.cumsum(word, dtype=np.uint64)
    return word[u], word[np.cumsum(v)], word[w], c


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10 probabilities) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in slices(batches, "text"):
            token, n = tokens(b.column("text"))
            p, base, c = scorer(token, n)
            first = np.cumsum(n) - n
            cols = [pa.array(n), pa.array(np.add.reduceat((c > 0).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(p, first))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    d = texts(docs)
    kinds = (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))
    return d.mapInArrow(run, T.StructType([d.schema["doc_id"], *(T.StructField(*k) for k in kinds)]))

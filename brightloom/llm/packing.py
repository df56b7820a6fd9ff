"""Best-fit packing of token sequences.

Documents are tokenized, ended by id 0 and cut into pieces of at most `limit` tokens (only longer documents are cut; the
first piece takes the remainder). Pieces then enter sequences by best-fit decreasing: longest first, each into the open
sequence with the tightest room, found by a segment tree over remaining capacities. As lengths are at most `limit`, the
whole order is determined by how many pieces have each length: the driver packs that histogram (at most `limit` counts,
whatever the input) in runs of equal moves, and every piece finds its place from its rank among pieces of its length.
So the packing is that of one global best-fit decreasing, and no task or driver holds more than the histogram.

Null or empty texts are a document of the one token 0. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ranked, slices, stage, texts

LIMIT = 2048
#: How byte-level BPE parts a text before merging.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: White space in a row that the pattern still takes (its matcher's stack overflows near a million).
BLANKS = 50_000
_BLANKS = re.compile(rf"\s{{{BLANKS}}}")


class Tightest:
    """A segment tree over 0..size: which values are present, and the least present at or above one."""

    def __init__(self, size: int):
        self.leaves = 1 << max(1, size).bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, value: int, present: bool) -> None:
        i = value + self.leaves
        self.any[i] = present
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def at_least(self, value: int) -> int | None:
        i = value + self.leaves
        if self.any[i]:
            return value
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i + (not self.any[2 * i])
                return i - self.leaves
            i >>= 1
        return None


def plan(counts: dict[int, int], limit: int = LIMIT) -> np.ndarray:
    """Best-fit decreasing of counts[length] pieces. Rows: length, first rank, pieces, first sequence, pieces per sequence, offset.

    Pieces first rank + i of that length lie in sequence first + i // per at offset + (i % per) * length.
    """
    tree, open_, runs, bins = Tightest(limit), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.at_least(length)
            if room is None:
                room, first = limit, bins
                n = -(-left // (limit // length))
                bins += n
            else:
                first, n = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
            per = min(room // length, left)
            use = min(n, left // per)
            runs.append((length, rank, use * per, first, per, limit - room))
            put(room - per * length, first, use)
            put(room, first + use, n - use)
            left -= use * per
            rank += use * per
    return np.array(runs, np.int64).reshape(-1, 6)


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Of a byte-level BPE whose ids follow its merges (so that the lower id is the earlier merge), the ranks; else None."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") not in (None, "BPE") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer") or model.get("byte_fallback"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    vocab = model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != list(range(256, 256 + len(merged))):
        return None
    special = {t["content"] for t in spec.get("added_tokens", ())}
    return {bytes(byte[c] for c in w): i for w, i in vocab.items() if w not in special}


class _Ids:
    """Texts to little-endian ids, those of `tokenizers` for the file at path without added special tokens.

    The texts of a byte-level BPE go through tiktoken's merges of the same vocabulary, which give the same ids; texts that
    hold an added token's string, or a run of white space too long for tiktoken's pattern, and other models, through `tokenizers`.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = _ranks(spec)
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        self.merges = ranks and tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _slow(self, text: str) -> bool:
        return any(t in text for t in self.added) or len(text) > BLANKS and _BLANKS.search(text) is not None

    def __call__(self, batch: list[str]) -> list[bytes]:
        slow = range(len(batch)) if not self.merges else [i for i, text in enumerate(batch) if self._slow(text)]
        made = self.tokenizer.encode_batch_fast([batch[i] for i in slow], add_special_tokens=False)
        out = {i: np.array(e.ids, "<u4").tobytes() for i, e in zip(slow, made, strict=True)}
        return [out[i] if i in out else array("I", self.merges(text)).tobytes() for i, text in enumerate(batch)]


@functools.cache
def _ids(path: str) -> _Ids:
    """A worker's tokenizer, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _Ids(path)


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of each row of docs (doc_id, text). tokenizer: a file of `tokenizers`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _ids(tokenizer)
        for b in slices(batches, "text", 2_000_000):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(ids_of(b.column("text").to_pylist())):
                ids += b"\0\0\0\0"
                n = len(ids) // 4
                first = n % limit or limit
                cuts = [0, *range(first, n + 1, limit)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[4 * s : 4 * e]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    d = texts(docs)
    long = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    return d.mapInArrow(run, T.StructType([d.schema["doc_id"], T.StructField("piece", T.IntegerType()), *long]))


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """pieces (doc_id, piece, start, length 1..limit, ids_crc32) with sequence_id and offset."""
    cut = stage(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan(counts, limit)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    span, names = 1 << 48, cut.columns
    keys = runs[:, 0] * span + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = runs[np.searchsorted(keys, length * span + rank, side="right") - 1]
            i = rank - at[:, 1]
            place = [pa.array(at[:, 3] + i // at[:, 4]), pa.array(at[:, 5] + i % at[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *place], [*names, "sequence_id", "offset"])

    with_rank = ranked(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"], sum(counts.values()))
    schema = T.StructType([*cut.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return with_rank.select(*names, "rank").mapInArrow(run, schema)

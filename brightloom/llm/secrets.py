"""Secret scan: fixed patterns, and values in credential contexts whose guess cost is high.

Patterns give spans of kinds assign, access and hex (see find). A value that a credential word introduces ("password is X",
"Bearer X", "auth token X"; a cheap value that is such a word itself introduces the next one) is cut into words, dates,
repeats, keyboard walks and brute-force spans at the least total guess cost, by dynamic programming over its characters and
every span of up to SPAN of them.
From 10^COST guesses on it is a span of kind guess: a placeholder such as "changeme123" or "example" is cheap, a random
string, of letters only or not, is not. Words are common ones and, for values of letters only (which may be prose), those
that two tokenizers' vocabularies hold, by rank. Spans are in code points, end exclusive.

Null or empty texts have no spans. Every text is read whole; a value's cost takes time in proportion to its length.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_slices, ship, slices, texts

KINDS = ("assign", "access", "hex", "guess")
#: Power of ten of guesses from which a value counts as a secret.
COST = 9.0
#: The most characters of a segment, and what each cut adds.
SPAN, CUT = 64, 0.3
_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_STEMS = ("passw", "secret", "token", "api")
_CREDENTIAL = r"(?ai:\b(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|bearer|api[ _-]?key|access[ _-]?key|private[ _-]?key|client[ _-]?secret|credentials?|auth(?:orization)?))\b"
_INTRODUCES = re.compile(_CREDENTIAL)
_CONTEXT = re.compile(
    _CREDENTIAL
    + r"[\"']?\x20{0,4}(?:(?ai:is|was)\x20|[:=]|->)?\x20{0,4}[\"'`]?([^\s\"'`<>,;]+)"
)
_CONTEXT_STEMS = ("pass", "pwd", "secret", "token", "bearer", "key", "credential", "auth")
_COMMON = (
    "password pass admin user root login welcome letmein monkey dragon master qwerty secret changeme change me test example sample demo default guest "
    "placeholder your token here key api insert value string none null true false hidden redacted xxxx foo bar baz my the new old temp hello world love "
    "summer winter spring autumn sunshine princess football baseball shadow superman batman trustno iloveyou access server database local host prod dev "
    "stage staging public private client service account access basic bearer auth id name email mail company office team data cloud amazon google web app "
    "with and for that this from have not are was can will out one two three four five six seven eight nine ten black white red blue green house dog cat "
    "time year day people water first last long great little own other right big high different small large next early young important few same able "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "passwort geheim clave contrasena secreto motdepasse bonjour hola hallo amor liebe amour casa haus maison"
).split()
_VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


@functools.cache
def _ranks(letters: bool) -> tuple[dict[str, int], int]:
    """The place of each common word, then, with letters, of the vocabularies' tokens that begin a word; the longest's length."""
    out = {w: i + 1 for i, w in reversed(list(enumerate(_COMMON)))}
    if letters:
        import public_tokenizers
    for name in _VOCABULARIES if letters else ():
        with open(public_tokenizers.path(name), "rb") as lines:
            for line in lines:
                token, rank = line.split()
                word = base64.b64decode(token).decode("utf-8", "replace").lower()
                if word[:1] == " " and len(word) > 3 and word[1:].isalpha():
                    out[word[1:]] = min(out.get(word[1:], 1 << 30), len(_COMMON) + int(rank))
    return out, max(map(len, out))


_LEET = str.maketrans("04318$5@7", "oaeibssat")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, i + 0.5 * r) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1.0


def segments(value: str) -> Iterator[tuple[int, int, float]]:
    """Every span that a segment of the value may be, with its cost; brute-force characters apart. Spans have at most SPAN characters."""
    n, low = len(value), value.lower()
    plain, (ranks, longest) = low.translate(_LEET), _ranks(value.isalpha())
    for i in range(n):
        most = min(n, i + SPAN)
        for j in range(i + 3, min(most, i + longest) + 1):
            for form, extra in ((low[i:j], 0.0), (plain[i:j], 0.6)):
                if form in ranks:
                    case = 0.0 if value[i:j].islower() else 0.3 if value[i:j].istitle() or value[i:j].isupper() else 1.0
                    yield i, j, math.log10(ranks[form] + 1) + case + (extra if form != low[i:j] else 0.0)
                    break
        if value[i].isdigit():
            for j in range(i + 4, min(most, i + 10) + 1):
                if _DATE.fullmatch(value, i, j):
                    yield i, j, 2.0 if j - i == 4 else 4.3
        j = i + 1
        while j < most and value[j] == value[i]:
            j += 1
            if j - i >= 3:
                yield i, j, math.log10(12.0 * (j - i))
        j, turns = i + 1, 0
        while j < most and _near(low[j - 1], low[j]):
            turns += _PLACE[low[j - 1]][0] != _PLACE[low[j]][0]
            j += 1
            if j - i >= 4:
                yield i, j, math.log10(47.0 * (j - i)) + 0.35 * turns
        for step in (1, -1):
            j = i + 1
            while j < most and low[j].isalnum() and low[j - 1].isalnum() and ord(low[j]) - ord(low[j - 1]) == step:
                j += 1
                if j - i >= 3:
                    yield i, j, math.log10(8.0 * (j - i))
        for p in range(2, 17):  # a block in a row costs what it costs once, times the rounds
            unit = low[i : i + p]
            if low[i + p : i + 2 * p] != unit or len(set(unit)) < 2:
                continue
            once, j = min(1.0 * p, math.log10(ranks[unit] + 1) if unit in ranks else 99.0), i + 2 * p
            while j <= most and low[j - p : j] == unit:
                yield i, j, once + math.log10((j - i) / p)
                j += p


def brute(character: str) -> float:
    """A brute-force character costs a factor of ten, a digit a little less."""
    return 0.9 if character.isdigit() else 1.0


def guess_cost(value: str) -> float:
    """Base-10 logarithm of the guesses that the cheapest segmentation needs; each segment that is no brute force adds CUT."""
    by_end: list[list[tuple[int, float]]] = [[] for _ in range(len(value) + 1)]
    for i, j, cost in segments(value):
        by_end[j].append((i, cost + CUT))
    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min([best[j - 1] + brute(value[j - 1]), *(best[i] + cost for i, cost in by_end[j])]))
    return best[-1]


def find(text: str, cost: float = COST) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The pattern spans and the guess-cost spans, each by start and then kind."""
    base, more, low = [], [], text.lower()
    if any(s in low for s in _STEMS):
        base += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if any(s in low for s in _CONTEXT_STEMS):
        m = _CONTEXT.search(text)
        while m:
            value, at = m[1].rstrip(".:!?)"), m.end()
            if len(value) >= 6 and guess_cost(value) >= cost:
                more.append(("guess", m.start(1), m.start(1) + len(value)))
            elif _INTRODUCES.match(text, m.start(1)):
                at = m.start(1)
            m = _CONTEXT.search(text, at)
    order = lambda s: (s[1], KINDS.index(s[0]))
    return sorted(base, key=order), sorted(more, key=order)


def join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, cost: float = COST) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_guess of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            counts, digest, spans = [[] for _ in KINDS], [], []
            for text in b.column("text").to_pylist():
                base, added = find(text, cost)
                both = sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))
                for kind, n in zip(KINDS, counts, strict=True):
                    n.append(sum(s[0] == kind for s in both))
                digest.append(hashlib.sha256(join(base).encode()).hexdigest())
                spans.append(join(both))
            *counts, guesses = (pa.array(n, pa.int64()) for n in counts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(digest, pa.string()), pa.array(spans, pa.string()), guesses], ["doc_id", *(m.name for m in more)])

    d = texts(docs)
    more = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:-1]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_guess", T.LongType())]
    return d.mapInArrow(run, T.StructType([d.schema["doc_id"], *more]))


def redacted(text: str, mark: str = "[SECRET]", cost: float = COST) -> str:
    """text with every span, overlapping ones as one, replaced by the mark."""
    out, at = [], 0
    base, more = find(text, cost)
    for _, s, e in sorted(base + more, key=lambda x: x[1]):
        if e > at:
            if s >= at:
                out += [text[at:s], mark]
            at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, cost: float = COST) -> DataFrame:
    """docs, all columns, with the secrets in text replaced; a null text stays null."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts_ in batches:
            yield by_slices(texts_, lambda part: [None if t is None else redacted(t, cost=cost) for t in part], pa.string())

    return docs.withColumn("text", F.arrow_udf(run, "string")(F.col("text").cast("string")))

"""SpotSigs fingerprints, by DataFrame functions only.

A spot is a common word (anchor, of four languages) and the chain of the CHAIN = 2 content words after it; anchors between
are passed over. A text's fingerprint is the sorted set of its spots' 32-bit hashes, written as eight hex digits each. A
text without spots is fingerprinted by its words, one without words by its whole self; the empty text has the empty set.
Likeness is the Jaccard similarity of two sets (1 for two empty ones). Words are runs of letters and digits, lower-cased.

similar() finds all pairs of distinct sets at or above a threshold: only sets whose lengths allow it are compared (their
partition by length), and only if they share one of the rarest spots that any similar pair must share (prefix pruning).

Null texts count as empty. Repeated doc_ids are taken in the order of their texts' hashes; null ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, texts

ANCHORS = tuple(
    "a an the this that these those of to in on at by for from with and or but as is are was were be been it he she they we you not there which who what when "
    "der die das den dem des ein eine einer und oder in im von mit zu auf für ist als auch sich nicht an bei "
    "el la los las un una unos de del que y o en por para con se es su al lo no como más "
    "le les des du et ou dans est que qui pour par sur avec ne pas plus ce cette".split()
)
#: Documents a bucket of the neighbour search holds, and the most buckets.
BUCKET_ROWS, BUCKETS = 5_000, 4096
SAMPLE = 20


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def spots(text: Column) -> Column:
    """The sorted distinct spot hashes of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    stop = list(dict.fromkeys(ANCHORS))

    def from_content(w: Column, content: Column) -> Column:
        before = F.concat(F.array(F.struct(F.lit("").alias("w"), F.lit(-1).alias("i"))), content)
        one = F.zip_with(before, content, lambda a, b: F.struct(a["i"].alias("p"), b["i"].alias("i"), b["w"].alias("w")))
        two = F.zip_with(one, F.slice(content, 2, F.greatest(F.size(content), F.lit(1))), lambda a, b: F.struct(a["p"].alias("p"), a["i"].alias("i"), a["w"].alias("w"), b["w"].alias("n")))
        chained = F.filter(two, lambda x: (x["i"] - x["p"] > 1) & x["n"].isNotNull())
        return F.flatten(F.transform(chained, lambda x: F.transform(F.slice(w, x["p"] + 2, x["i"] - x["p"] - 1), lambda a: F.hash(a, x["w"], x["n"]))))

    def from_words(w: Column) -> Column:
        content = F.array_compact(F.transform(w, lambda x, i: F.when(~x.isin(stop), F.struct(x.alias("w"), i.alias("i")))))
        found = _let(content, lambda c: from_content(w, c))
        return _let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.transform(w, lambda x: F.hash(F.lit(""), x))))

    spotted = _let(words, from_words)
    return _let(
        spotted, lambda s: F.when(F.size(s) > 0, F.array_sort(F.array_distinct(s))).when(text == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(text)))
    )


def written(sigs: Column) -> Column:
    """The set as text."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def _bucket(doc_id: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at or below doc_id, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    all_ = F.lit(bounds)
    return F.aggregate(steps, F.lit(0), lambda at, k: F.when((at + k <= len(bounds)) & (F.try_element_at(all_, at + k) <= doc_id), at + k).otherwise(at))


def _quantiles(d: DataFrame, cuts: int) -> list:
    """Ids that part the rows about evenly: quantiles of numbers; of other ids those of the SAMPLE for each cut with the least hashes."""
    if isinstance(d.schema["doc_id"].dataType, T.NumericType):
        return d.agg(F.percentile_approx("doc_id", [i / (cuts + 1) for i in range(1, cuts + 1)], 20_000)).first()[0] or []
    known = d.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id")).limit(SAMPLE * (cuts + 1))
    ids = sorted(r["doc_id"] for r in known.collect())
    return [ids[len(ids) * i // (cuts + 1)] for i in range(1, cuts + 1)] if ids else []


def with_next(docs: DataFrame, extra: dict[str, Column]) -> DataFrame:
    """doc_id, text and extra columns (of text), and next_<column> of the row after it by doc_id (after the last: the first).

    Rows are bucketed by quantiles of doc_id and sorted in their buckets; the first row of each bucket also goes to the
    bucket before, where the last row finds it. At most SAMPLE * BUCKETS ids come to the driver.
    """
    d = texts(docs)
    n = d.count()
    cuts = min(BUCKETS, n // BUCKET_ROWS)
    bounds = sorted(set(_quantiles(d, cuts))) if cuts else []
    d = d.withColumn("b", _bucket(F.col("doc_id"), bounds))
    heads = sorted((r["b"], r["head"]) for r in d.groupBy("b").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id"))["doc_id"].alias("head")).collect())
    targets = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    at = docs.sparkSession.createDataFrame(targets, f"head {docs.schema['doc_id'].dataType.simpleString()}, target int")
    copies = d.join(F.broadcast(at), F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("target").alias("b"), F.lit(True).alias("copy"))
    rows = d.select("doc_id", "text", "b", F.lit(False).alias("copy")).union(copies)
    rows = rows.select("*", *(c.alias(k) for k, c in extra.items()))
    # the first of all is copied behind the last of all
    order = Window.partitionBy("b").orderBy("copy", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    led = rows.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *extra)))
    return led.where(~F.col("copy")).drop("b", "copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and sigs (the set) of each row of docs (doc_id, text)."""
    return texts(docs).select("doc_id", spots(F.col("text")).alias("sigs"))


def edits(docs: DataFrame) -> DataFrame:
    """How fingerprints follow an edit: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends, from three quarters on, as the next document begins.
    """
    led = with_next(docs, {"sigs": spots(F.col("text"))})
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    with_edit = led.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sigs", "next_sigs")
    with_sigs = with_edit.select("*", spots(F.col("edited")).alias("edited_sigs"))
    return with_sigs.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        written(F.col("sigs")).alias("fingerprint"), written(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def similar(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, set_id) and pairs (a, b, likeness) of distinct non-empty sets with likeness >= threshold > 0.

    set_id is the hash of a set, which documents of equal fingerprints share.
    """
    rows = stage(fingerprints(docs).select("doc_id", "sigs", F.xxhash64("sigs").alias("set_id")), "spots")
    sets = stage(rows.where(F.size("sigs") > 0).groupBy("set_id").agg(F.first("sigs").alias("sigs")), "sets")
    each = sets.select("set_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("set_id").orderBy("df", "sig")
    # a similar pair shares a spot among the first n - ceil(threshold * n) + 1 by rarity of either
    prefix = each.join(often, "sig").where("df > 1").select("set_id", "n", "sig", "df")
    prefix = prefix.withColumn("k", F.row_number().over(rarest)).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("set_id", "n", "sig")
    a, b = (prefix.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), "sig") for x in "ab")
    by_length = (F.col("n_a") <= F.col("n_b")) & (F.col("n_a") >= F.col("n_b") * threshold - 1e-9)
    ordered = (F.col("n_a") < F.col("n_b")) | (F.col("a") < F.col("b"))
    met = a.join(b, "sig").where(by_length & ordered & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    full = met.join(sets.toDF("a", "sigs_a"), "a").join(sets.toDF("b", "sigs_b"), "b")
    pairs = full.select("a", "b", likeness(F.col("sigs_a"), F.col("sigs_b")).alias("likeness")).where(F.col("likeness") >= threshold - 1e-9)
    return rows.select("doc_id", "set_id"), pairs

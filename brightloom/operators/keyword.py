"""BM25 keyword search and reusable keyword indexes. Tokens come from native regular expressions; only query terms are shuffled."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector import with_row_id

K1, B = 1.2, 0.75
_CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; of each CJK run all 1-, 2- and 3-grams and, if 2 to 8 long, itself once more."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = text  # the two characters beyond ASCII whose small letter is in ASCII part words like any other
    for c in ("\u0130", "\u212a"):
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    ascii_ = F.array_remove(F.split(F.lower(plain), "[^a-z0-9]+"), "")

    none = F.array().cast("array<string>")

    def slices(run: Column, k: int) -> Column:
        n = F.length(run)
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(run, i, F.lit(k)))).otherwise(none)

    def grams(run: Column) -> Column:
        return F.concat(*(slices(run, k) for k in (1, 2, 3)), F.when(F.length(run).between(2, 8), F.array(run)).otherwise(none))

    runs = F.regexp_extract_all(text, F.lit(_CJK), F.lit(0))
    may = (F.octet_length(text) > F.length(text)) & text.rlike(_CJK)
    return F.when(may, F.concat(ascii_, F.flatten(F.transform(runs, grams)))).otherwise(ascii_)


def query_terms(spark: SparkSession, query: str) -> list[str]:
    terms = list(dict.fromkeys(spark.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]))
    if not terms:
        raise ValueError("keyword query has no tokens")
    return terms


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _gain(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bm25(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """docs (with tokens, length and all other columns) scored: keyword_score over zero.

    A row's count of a term is what its tokens lose by the term's removal; N, the mean length and document frequencies are
    one aggregate.
    """
    tf = [F.size("__tokens") - F.size(F.array_remove("__tokens", t)) for t in terms]
    counted = docs.withColumn("__tf", F.array(*tf)).withColumn("__length", F.size("__tokens"))
    stats = counted.agg(
        F.count(F.lit(1)).alias("__n"), F.avg("__length").alias("__average"), F.array(*[F.sum((F.col("__tf")[i] > 0).cast("long")) for i in range(len(terms))]).alias("__df")
    )
    joined = counted.where(F.exists("__tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))  # stats is one row
    parts = [_idf(F.col("__n"), F.col("__df")[i]) * _gain(F.col("__tf")[i], F.col("__length"), F.col("__average")) for i in range(len(terms))]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return joined.withColumn("keyword_score", total).drop("__tokens", "__tf", "__length", "__n", "__average", "__df").where("keyword_score > 0")


def keyword_search(df: DataFrame, columns: Sequence[str], query: str, top_k: int = 10, tie: str | None = None) -> DataFrame:
    """The top_k rows of df by BM25 over the columns taken together, all columns and keyword_score. df is the whole corpus."""
    if "keyword_score" in df.columns:
        raise ValueError("column already exists: keyword_score")
    terms = query_terms(df.sparkSession, query)
    found = bm25(df.withColumn("__tokens", F.concat(*(tokens(F.col(f"`{c}`")) for c in columns))), terms)
    return found.orderBy(F.col("keyword_score").desc(), *([F.col(f"`{tie}`")] if tie else [])).limit(max(1, top_k))


def _counts(tokens_: Column) -> Column:
    """Structs (term, tf) of an array's distinct tokens: runs of the sorted array, so nothing is shuffled."""

    def runs(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: ~F.get(s, i - 1).eqNullSafe(F.get(s, i)))
        return F.transform(F.array(ends), lambda e: F.transform(e, lambda end, k: F.struct(F.get(s, end - 1).alias("term"), (end - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("long").alias("tf"))))[0]

    return F.when(F.size(tokens_) > 0, F.transform(F.array(F.sort_array(tokens_)), runs)[0])  # array_sort would call its comparator as a lambda


def _postings(docs: DataFrame) -> DataFrame:
    """term, __doc_id, tf. A row's tokens are counted where it lies; only rows whose id comes again are added up across rows."""
    apart = lambda df: df.select("__doc_id", F.inline(_counts(F.col("__tokens")))).select("term", "__doc_id", "tf")
    again = docs.groupBy("__doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("__doc_id").alias("__again"))
    if again.isEmpty():
        return apart(docs)
    same = F.col("__doc_id").eqNullSafe(F.col("__again"))
    merged = apart(docs.join(again, same, "left_semi")).groupBy("term", "__doc_id").agg(F.sum("tf").alias("tf"))
    return apart(docs.join(again, same, "left_anti")).union(merged)


def build_keyword_index(tables: Sequence[DataFrame], text_columns: Sequence[str], path: str, source_labels: Sequence[str] | None = None, doc_id_field: str | None = None, analyzer: str = "builtin") -> str:
    """Writes docs, terms and postings (Parquet) and manifest.json under path; returns path.

    __source_row_id is a row's position in its table; __doc_id the field named, or else source and position.
    """
    if analyzer not in ("builtin", "jieba"):
        raise ValueError(f"unsupported analyzer: {analyzer}")
    if analyzer == "jieba":
        raise ImportError("the jieba analyzer needs its package and dictionary, which this engine doesn't have; builtin indexes n-grams")
    labels = list(source_labels or (f"dataset_{i}" for i in range(len(tables))))
    docs = None
    for label, t in zip(labels, tables, strict=True):
        one = with_row_id(t, "__source_row_id").withColumn("__source_dataset", F.lit(label))
        key = F.col(f"`{doc_id_field}`").cast("string") if doc_id_field else F.concat_ws(":", F.lit(label), F.col("__source_row_id").cast("string"))
        one = one.withColumn("__doc_join_key", key)
        docs = one if docs is None else docs.unionByName(one, allowMissingColumns=True)
    docs = docs.withColumn("__tokens", F.concat(*(tokens(F.col(f"`{c}`")) for c in text_columns)))
    docs = docs.withColumn("__doc_id", F.col("__doc_join_key")).withColumn("__doc_length", F.size("__tokens").cast("long"))
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    docs = docs.sparkSession.read.parquet(f"{path}/docs")
    _postings(docs).write.mode("overwrite").parquet(f"{path}/postings")
    postings = docs.sparkSession.read.parquet(f"{path}/postings")
    postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("__doc_length").alias("average")).first()
    manifest = {"analyzer": "builtin", "requested_analyzer": analyzer, "text_columns": list(text_columns), "sources": labels, "doc_count": stats["n"], "avg_doc_length": stats["average"] or 0.0, "k1": K1, "b": B}
    docs.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    if os.path.isdir(path.removeprefix("file://")):
        with open(os.path.join(path.removeprefix("file://"), "manifest.json"), "w") as f:
            json.dump(manifest, f)
    return path


def search_keyword_index(spark: SparkSession, path: str, query: str, top_k: int = 10, where: str | Column | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """The top_k documents of an index with keyword_score. where or allowed (__doc_id) narrow the corpus, statistics included."""
    docs = spark.read.parquet(f"{path}/docs").drop("__tokens")
    postings = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(query_terms(spark, query)))
    terms = spark.read.parquet(f"{path}/terms")
    if where is not None or allowed is not None:
        docs = docs.where(where) if where is not None else docs
        docs = docs.join(allowed.select("__doc_id").distinct(), "__doc_id", "left_semi") if allowed is not None else docs
        postings = postings.join(docs.select("__doc_id"), "__doc_id", "left_semi")
        terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("__doc_length").alias("average"))
    matched = postings.join(terms, "term").join(docs.select("__doc_id", "__doc_length"), "__doc_id").crossJoin(F.broadcast(stats))
    gain = _idf(F.col("n"), F.col("df")) * _gain(F.col("tf"), F.col("__doc_length"), F.col("average"))
    top = matched.groupBy("__doc_id").agg(F.sum(gain).alias("keyword_score")).where("keyword_score > 0").orderBy(F.col("keyword_score").desc(), "__doc_id").limit(max(1, top_k))
    return docs.join(F.broadcast(top), "__doc_id").orderBy(F.col("keyword_score").desc(), "__doc_id")

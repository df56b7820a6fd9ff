"""Text embeddings: templates, deterministic hash vectors, versioned datasets, and searches over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vector
from .keyword import tokens

FIELDS = ("title", "summary", "content", "body", "tags")


def render_text_template(df: DataFrame, fields: Sequence[str] = FIELDS, text_field: str = "text") -> Column:
    """The text column, or else 'field: value' lines of the fields, or of all other columns if none of these has a value."""

    def lines(names: Sequence[str]) -> Column:
        shown = [F.when(F.trim(F.col(f"`{n}`").cast("string")) != "", F.concat(F.lit(f"{n}: "), F.trim(F.col(f"`{n}`").cast("string")))) for n in names]
        return F.nullif(F.concat_ws("\n", *shown), F.lit("")) if shown else F.lit(None).cast("string")

    own = [n for n in fields if n in df.columns]
    rest = [n for n in df.columns if n not in fields and n != text_field]
    direct = F.nullif(F.trim(F.col(f"`{text_field}`").cast("string")), F.lit("")) if text_field in df.columns else F.lit(None).cast("string")
    return F.coalesce(direct, lines(own), lines(rest), F.raise_error(F.lit("no text to embed")).cast("string"))


def build_embedding_rows(df: DataFrame, doc_id: str | None = None, template_version: str = "text-v1") -> DataFrame:
    """df with doc_id (the column named, else doc-<position>), text and template_version."""
    text = render_text_template(df)
    if doc_id is None:
        df = vector.with_row_id(df, "__at")
        return df.select("*", text.alias("__text"), F.concat(F.lit("doc-"), F.col("__at").cast("string")).alias("__id")).drop("__at", "doc_id", "text").withColumnsRenamed({"__text": "text", "__id": "doc_id"}).withColumn("template_version", F.lit(template_version))
    return df.withColumn("__text", text).withColumn("__id", F.col(f"`{doc_id}`").cast("string")).drop("doc_id", "text").withColumnsRenamed({"__text": "text", "__id": "doc_id"}).withColumn("template_version", F.lit(template_version))


def select_embedding_updates(rows: DataFrame, existing: DataFrame, embedding_version: str) -> DataFrame:
    """Rows (doc_id, source_updated_at) that existing lacks, or has of another version or source time."""
    last = existing.select("doc_id", F.col("embedding_version").alias("__v"), F.col("source_updated_at").alias("__t"), F.lit(True).alias("__old"))
    changed = F.col("__old").isNull() | ~F.col("__v").eqNullSafe(F.lit(embedding_version)) | ~F.col("__t").eqNullSafe(F.col("source_updated_at"))
    return rows.join(last, "doc_id", "left").where(changed).select(*rows.columns)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f names it."""
    return F.transform(F.array(value), f)[0]


def hash_embedding(text: Column, dim: int) -> Column:
    """A unit vector of little-endian 32-bit words of SHA-256 over the text and a counter, scaled to [-1, 1]. All in the JVM.

    A digest is hashed once for its eight words, and the norm is taken once a vector.
    """
    low = F.lit(0x0F0F0F0F).cast("long")

    def words(t: Column, c: Column) -> Column:
        mirrored = F.reverse(F.sha2(F.concat(t, F.lit("\n"), c.cast("string")), 256))  # eight digits have a word's bytes in order, but the two digits of each not
        parts = _once(mirrored, lambda h: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(h, F.lit(57) - i * 8, F.lit(8)), 16, 10).cast("long")))
        return F.transform(parts, lambda x: (F.shiftleft(x.bitwiseAND(low), 4) + F.shiftright(x, 4).bitwiseAND(low)).cast("double") / 4294967295.0 * 2.0 - 1.0)

    raw = _once(text, lambda t: F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(-(-dim // 8) - 1)), lambda c: words(t, c))), 1, dim))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return _once(raw, lambda v: _once(norm(v), lambda n: F.transform(v, lambda x: (x / n).cast("float"))))


def _spread(rows: DataFrame) -> DataFrame:
    """rows over as many tasks as there are cores, as a vector costs far more than its row; those that fill so many splits by their size stay as they lie.

    A file of few bytes may hold very many rows (one row group of repeated texts), and is read by one task.
    """
    spark = rows.sparkSession
    cores, plan = max(1, spark.sparkContext.defaultParallelism), rows._jdf.queryExecution().optimizedPlan()
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return rows if int(str(plan.stats().sizeInBytes())) > cores * split else rows.repartition(cores)


def materialize_embeddings(rows: DataFrame, path: str, dim: int = 32, version: str = "v1", provider: str | Callable = "hash", model: str = "hash") -> DataFrame:
    """rows (text) with embedding, embedding_version, provider_name, model_name, dimension, embedded_at, written as Parquet and read back.

    provider: "hash", or a function of a list of texts to a list of vectors, run over Arrow batches.
    """
    rows = _spread(rows)
    if callable(provider):
        import pandas as pd

        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series([[float(x) for x in v] for v in provider(s.fillna("").tolist())])

        made = F.pandas_udf(embed, "array<float>")(F.col("text"))
    else:
        made = hash_embedding(F.col("text"), dim)
    out = rows.select(
        "*", made.alias("embedding"), F.lit(version).alias("embedding_version"), F.lit(getattr(provider, "__name__", provider)).alias("provider_name"), F.lit(model).alias("model_name"),
        F.lit(dim).alias("dimension"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("embedded_at"),
    )
    out.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def embed_query(df: DataFrame, text: str, dim: int) -> list[float]:
    return df.sparkSession.range(1).select(hash_embedding(F.lit(text), dim).alias("v")).first()["v"]


def query_embeddings(df: DataFrame, text: str, top_k: int = 10, where: str | None = None, metric: str = "cosine", score_threshold: float | None = None, column: str = "embedding", dim: int = 32, tie: str | None = None) -> DataFrame:
    """Hybrid search of a dataset's embeddings for a text, after a filter."""
    return vector.hybrid_search(df.where(where) if where else df, column, embed_query(df, text, dim), top_k, metric, score_threshold, tie)


def overlap_search(df: DataFrame, text_column: str, query: str, top_k: int = 10, dim: int = 32, tie: str | None = None) -> DataFrame:
    """Rows by 0.55 of the share of query words they hold and 0.45 of the cosine of hash embeddings (at least 0); score over zero.

    A score hangs on the text alone, so each text is scored once, however many rows have it, by tasks as many as there are
    cores. The first k rows have only texts that are among the first k by score and their least tie.
    """
    spark, words = df.sparkSession, list(dict.fromkeys(df.sparkSession.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]))
    text, k = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")), max(1, top_k)
    least = [F.min(F.struct(F.col(f"`{tie}`"))).alias("__least")] if tie else []  # a struct, since min passes over nulls, which come first
    texts = df.withColumn("__text", text).groupBy("__text").agg(*least) if tie else df.select(text.alias("__text")).distinct()
    share = F.size(F.array_intersect(tokens(F.col("__text")), F.array(*map(F.lit, words)))) / float(len(words)) if words else F.lit(0.0)
    q = spark.range(1).select(hash_embedding(F.lit(query), dim).alias("v")).first()["v"]
    spread = texts.repartition(max(1, spark.sparkContext.defaultParallelism), "__text")  # else adaptive execution hashes small texts in one task
    with_v = spread.withColumn("__v", hash_embedding(F.col("__text"), dim)).withColumn("__share", share)
    near = F.greatest(F.lit(0.0), 1.0 - vector.score(with_v, "__v", q, "cosine"))
    scored = with_v.withColumn("__near", near).drop("__v").withColumn("__score", 0.55 * F.col("__share") + 0.45 * F.col("__near"))
    best = scored.orderBy(F.col("__score").desc(), *(["__least"] if tie else [])).limit(k).drop("__least")
    found = df.withColumn("__text", text).join(F.broadcast(best), "__text").drop("__text")  # best is top_k rows
    top = found.orderBy(F.col("__score").desc(), *([F.col(f"`{tie}`")] if tie else [])).limit(k)
    top = top.withColumns({"keyword_score": F.col("__share"), "embedding_score": F.col("__near"), "score": F.col("__score")}).drop("__share", "__near", "__score")
    return top.where("keyword_score > 0 OR embedding_score > 0")  # rows of no score are last anyway; a condition before the limit would compute every score again


def grounding_bundle(parts: dict[str, tuple[DataFrame, str]], query: str, top_k: int = 5, dim: int = 32) -> DataFrame:
    """kind, item (JSON of the row), score of the best rows of each named table (DataFrame, text column)."""
    out = None
    for kind, (df, column) in parts.items():
        found = overlap_search(df, column, query, top_k, dim)
        one = found.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("item"), "score")
        out = one if out is None else out.union(one)
    return out


def latest_version(df: DataFrame, key: str = "doc_id", at: str = "embedded_at") -> DataFrame:
    """One row a key: the last embedded."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc()))).where("__k = 1").drop("__k")

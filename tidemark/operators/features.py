"""TF-IDF in long form, source encoding and text embedding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import analysed_words, ngrams
from tidemark.operators.recipe import exploded
from tidemark.schemas import KEY
from tidemark.session import cut


def term_counts(entries: DataFrame, text: Column, lengths: tuple[int, ...] = (1, 2, 3), words=analysed_words) -> DataFrame:
    """``(key, term, tf)`` counted before anything else."""
    t = exploded(entries.select(*KEY, words(text).alias("w")), ngrams(F.col("w"), lengths), *KEY).where("term IS NOT NULL")
    return t.groupBy(*KEY, "term").agg(F.count("*").alias("tf"))


def document_frequencies(counts: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.95, max_features: int = 10_000) -> DataFrame:
    """``(term, df, cf, idf)``: terms in at least ``min_df`` entries and at most the share ``max_df``, of these the ``max_features`` most
    frequent (ties by term); ``idf = ln((1 + n) / (1 + df)) + 1``."""
    return vocabulary(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), n_docs, min_df, max_df, max_features)


def vocabulary(df: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.95, max_features: int = 10_000) -> DataFrame:
    """The same from ``(term, df, cf)``."""
    df = df.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)).orderBy(F.col("cf").desc(), "term").limit(max_features)
    return df.withColumn("idf", F.log((1.0 + n_docs) / (F.col("df") + 1.0)) + 1.0)


def tfidf(counts: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``(key, term, value)``: sublinear term frequency times idf, each entry's vector of length 1."""
    raw = counts.join(frequencies.select("term", "idf"), "term").select(*KEY, "term", ((F.log("tf") + 1.0) * F.col("idf")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(*KEY)))
    return raw.select(*KEY, "term", (F.col("x") / norm).alias("value"))


def fit_tfidf(entries: DataFrame, text: Column, lengths: tuple[int, ...] = (1, 2, 3), words=analysed_words) -> tuple[DataFrame, DataFrame]:
    """``(values, vocabulary)``; where the usual limits leave no term, every term counts (5,000 at most)."""
    counts = cut(term_counts(entries, text, lengths, words))  # the texts are taken apart once
    n = entries.count()
    vocabulary = cut(document_frequencies(counts, n))
    if not vocabulary.limit(1).count():
        vocabulary = document_frequencies(counts, n, 1, 1.0, 5000)
    return tfidf(counts, vocabulary), vocabulary


def top_terms(values: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy(F.round("value", 6).desc(), "term")
    return values.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*KEY, "rank", "term", F.round("value", 4).alias("value"))


def hashing_embedder(dim: int = 64):
    """Batch model that needs no weights: signed hashes of words, averaged over the text, of length 1. The stand-in for a
    language model; any ``make_fn`` for ``predict_batch_udf`` with the same output can take its place."""

    def make():
        import xxhash

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for i, t in enumerate(texts):
                for w in str(t).lower().split():
                    h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
                    out[i, h % dim] += 1.0 if h >> 63 else -1.0
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norm > 0, norm, 1)

        return predict

    return make


def embed(df: DataFrame, text: Column, make=None, dim: int = 64, batch: int = 8) -> DataFrame:
    """``df`` with ``embedding``, by a batch model loaded once a Python worker."""
    udf = predict_batch_udf(make or hashing_embedder(dim), return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    return df.withColumn("embedding", udf(text))


def embed_pending(entries: DataFrame, text: Column, make=None, dim: int = 64) -> DataFrame:
    """Vectors for the entries that have none, all of them in one pass."""
    return embed(entries.where("embedding IS NULL").drop("embedding"), text, make, dim)


def bytes_to_vector(c: Column) -> Column:
    """float32 little-endian bytes to an array; null or a broken length: null."""

    @F.pandas_udf("array<float>")
    def convert(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return convert(c)


def vector_to_bytes(c: Column) -> Column:
    @F.pandas_udf("binary")
    def convert(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return convert(c)


def standardised(df: DataFrame, column: str = "features") -> tuple[DataFrame, object]:
    """Vectors with mean 0 and deviation 1 a dimension, and the fitted scaler."""
    from pyspark.ml.feature import StandardScaler

    model = StandardScaler(inputCol=column, outputCol=f"{column}_std", withMean=True, withStd=True).fit(df)
    return model.transform(df), model


def mean_pool(df: DataFrame, key: list[str], vector: str, mask: str) -> DataFrame:
    """Average of the unmasked token vectors of each key (``vector`` arrays, ``mask`` 0 or 1); nothing unmasked: zeros."""
    d = df.select(*key, F.posexplode(vector).alias("d", "x"), F.col(mask).alias("m"))
    m = d.groupBy(*key, "d").agg((F.sum(F.col("x") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))).alias("v"))
    return m.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("pooled"))

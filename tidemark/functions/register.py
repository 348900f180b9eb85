"""The library's functions for SQL text: ``register(spark)`` adds temporary functions to a session.

``slugify``, ``label_entropy``, ``label_softmax``, ``label_relevance`` and ``recipe_words`` are SQL functions that Catalyst inlines;
``lenient_json`` is vectorised; ``word_ngrams(text, n)`` is a table function.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lenient_json import repair_json
from tidemark.schemas import CLASS_WEIGHTS, CLASSES

_WEIGHTS = ", ".join(f"{CLASS_WEIGHTS[c]}D" for c in CLASSES)
_SQL = {
    "slugify(s STRING) RETURNS STRING": "coalesce(nullif(regexp_replace(regexp_replace(lower(trim(coalesce(s, ''))), '[^a-z0-9]+', '-'), '^-+|-+$', ''), ''), 'default')",
    "label_entropy(p ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(p, 0D, (a, x) -> a - IF(x > 0, x * log2(x), 0D))",
    "label_softmax(l ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "transform(l, x -> exp(x - array_max(l)) / aggregate(l, 0D, (a, y) -> a + exp(y - array_max(l))))",
    "label_relevance(p ARRAY<DOUBLE>) RETURNS DOUBLE": f"aggregate(zip_with(p, array({_WEIGHTS}), (x, y) -> x * y), 0D, (a, x) -> a + x)",
    "recipe_words(s STRING) RETURNS ARRAY<STRING>": r"regexp_extract_all(lower(coalesce(s, '')), '(?U)\\b[a-zA-Z0-9À-ɏ]{2,}\\b', 0)",
}


class WordNgrams:
    """``(position, ngram)`` of the white-space words of a text."""

    def eval(self, text: str, n: int) -> Iterator[tuple[int, str]]:
        words = (text or "").lower().split()
        for i in range(len(words) - n + 1):
            yield i, " ".join(words[i : i + n])


def register(spark: SparkSession) -> None:
    for head, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("lenient_json", repair_json)
    spark.udtf.register("word_ngrams", F.udtf(WordNgrams, returnType="position int, ngram string"))

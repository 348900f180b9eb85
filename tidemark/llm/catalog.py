"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.garble import garbled_documents
from tidemark.llm.knn import nearest_neighbours, neighbour_pairs
from tidemark.llm.langid import entry_languages, entry_segments, language_cases
from tidemark.llm.neardup import all_pairs, groups, near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.subset import varied_subset
from tidemark.llm.tokenize import encode_texts
from tidemark.sources.tables import table


def p1_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A varied subset for every request."""
    return varied_subset(table(spark, sf_dir, "entries"), table(spark, sf_dir, "subset_request"))


#: TESTDATA.md's case: three words, likeness 0.6, at least 30 features.
P2 = {"width": 3, "threshold": 0.6, "least": 30}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entries alike enough, copies written out."""
    return all_pairs(*near_duplicates(table(spark, sf_dir, "entries"), **P2))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups the pairs form: one row per entry with a partner."""
    return groups(*near_duplicates(table(spark, sf_dir, "entries"), **P2))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entries of which one is among the other's ten most similar."""
    return neighbour_pairs(nearest_neighbours(table(spark, sf_dir, "entries")))


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return entry_segments(table(spark, sf_dir, "entries"), table(spark, sf_dir, "entry_langs"), table(spark, sf_dir, "lang_alias"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the entries whose declaration is missing or wrong, or that mix languages."""
    return language_cases(*_segments(spark, sf_dir))


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry's languages with a confidence."""
    return entry_languages(_segments(spark, sf_dir)[0])


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every entry: field, first word, words, language, confidence."""
    return _segments(spark, sf_dir)[0].selectExpr("id", "inline(segments)").withColumnRenamed("first", "first_word")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_texts(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of every pack_spec row."""
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_spec"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold garbled text."""
    return garbled_documents(table(spark, sf_dir, "documents"), whole=False).select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents with their chains and, where nothing was lost, the original text."""
    return garbled_documents(table(spark, sf_dir, "documents"))


QUERIES = {"p4_found": p4_found, "p4_languages": p4_languages, "p4_segments": p4_segments, "p8_found": p8_found, "p8_restored": p8_restored, "p1_subset": p1_subset, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p6_ids": p6_ids, "p7_containers": p7_containers}
_P2 = """WITH t AS (SELECT DISTINCT id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(content, '')), '[\\p{L}\\p{N}]+') AS w FROM entries WHERE id IS NOT NULL),
 f AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM t),
 n AS (SELECT id, count(*) AS n FROM f GROUP BY id HAVING count(*) >= 30), g AS (SELECT id, f, n FROM f JOIN n USING (id)),
 s AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS s FROM g a JOIN g b ON a.f = b.f AND a.id < b.id GROUP BY ALL),
 p AS (SELECT id_a, id_b FROM s WHERE s * 1.0 / (na + nb - s) >= 0.6)"""

ORACLE: dict[str, str] = {
    "p2_found": f"{_P2} SELECT id_a, id_b FROM p",
    "p2_groups": f"""{_P2.replace("WITH t", "WITH RECURSIVE t")}, e AS (SELECT id_a AS x, id_b AS y FROM p UNION SELECT id_b, id_a FROM p), c(x, y) AS (SELECT x, y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x),
 k AS (SELECT id, list_sort(list(f)) AS fs FROM g GROUP BY id), l AS (SELECT e.x, count(DISTINCT b.fs) AS links FROM e JOIN k a ON a.id = e.x JOIN k b ON b.id = e.y WHERE a.fs <> b.fs GROUP BY ALL)
 SELECT x AS id, least(x, min(y)) AS group_id, coalesce(max(links), 0) AS links FROM c LEFT JOIN l USING (x) GROUP BY x""",
}

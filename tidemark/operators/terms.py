"""Terms of tokenised entries, counted and looked up batch by batch.

An entry's words stay in its own row: no term of a text is a row of a shuffle. Texts are taken apart once (``words``), and each
use is one pass over the words with numpy on Arrow batches, where a term is a number made of the numbers of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import KEY

#: Words taken at once; a longer text is taken alone.
PIECE = 1 << 19
VECTOR = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def _pieces(batch: pa.RecordBatch, column: str = "words") -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``PIECE`` words, or one row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _flat(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each word's number, its row, and the words by number."""
    n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    d = words.flatten().dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(words)), n), d.dictionary


def _grams(codes: np.ndarray, row: np.ndarray, base: int, lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(n, numbers, places)`` of the word sequences of each length; equal sequences have equal numbers. Numbers below 0 are no words."""
    key, span, whole = codes, base, codes >= 0
    for n in range(1, max(lengths) + 1):
        if len(row) < n:
            return
        if n > 1:
            if span * base >= 1 << 63:
                seen, key = np.unique(key, return_inverse=True)
                span = len(seen)
            key, span = key[:-1] * base + codes[n - 1 :], span * base
            whole = whole[:-1] & (codes[n - 1 :] >= 0) & (row[n - 1 :] == row[n - 2 : -1])
        if n in lengths:
            at = np.flatnonzero(whole)
            yield n, key[at], at


def _named(codes: np.ndarray, at: np.ndarray, n: int, names: pa.Array) -> pa.Array:
    parts = [names.take(pa.array(codes[at + j])) for j in range(n)]
    return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")


def term_frequencies(tokens: DataFrame, lengths: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``(term, df, cf)`` of ``words``: entries that hold the term, and how often it occurs."""

    def count(batches):
        for batch in batches:
            for piece in _pieces(batch):
                codes, row, names = _flat(piece.column("words"))
                for n, key, at in _grams(codes, row, max(1, len(names)), lengths):
                    if not len(at):
                        continue
                    order = np.argsort(key, kind="stable")  # rows stay in order within a term
                    k, r = key[order], row[at][order]
                    new = np.concatenate([[True], k[1:] != k[:-1]])
                    doc = new | np.concatenate([[True], r[1:] != r[:-1]])
                    first = np.flatnonzero(new)
                    df, cf = np.add.reduceat(doc.astype(np.int64), first), np.diff(np.append(first, len(k)))
                    yield pa.RecordBatch.from_arrays([_named(codes, at[order[first]], n, names).cast(pa.string()), pa.array(df), pa.array(cf.astype(np.int64))], ["term", "df", "cf"])

    each = tokens.select("words").mapInArrow(count, "term string, df long, cf long")
    return each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


class Lookup:
    """Finds the terms of a list in the words of a batch: ``found`` gives row, place in the list and number, in order of both. It is made on the
    driver and travels as a few arrays."""

    def __init__(self, terms: list[str] | pa.Array, lengths: tuple[int, ...] = (1, 2, 3)):
        terms = terms if isinstance(terms, pa.Array) else pa.array(terms, pa.string())
        parts = pc.split_pattern(terms, " ")
        n = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        known = parts.filter(pa.array(np.isin(n, lengths))).flatten().dictionary_encode()
        self.size, self.words, self.base, self.keys = max(1, len(terms)), known.dictionary, max(1, len(known.dictionary)), {}
        if self.base ** max(lengths) >= 1 << 63:
            raise ValueError("too many words to look up")
        for k in lengths:
            places = np.flatnonzero(n == k)
            if not len(places):
                continue
            codes = pc.index_in(parts.take(pa.array(places)).flatten(), value_set=self.words).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, k)
            key = codes @ np.array([self.base ** (k - 1 - j) for j in range(k)], np.int64)
            order = np.argsort(key)
            self.keys[k] = (key[order], places[order])

    def found(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, row, names = _flat(words)
        ids = pc.fill_null(pc.index_in(names.cast(pa.string()), value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        hits = [np.zeros(0, np.int64)]
        if self.keys and len(codes):
            for n, key, at in _grams(ids[codes], row, self.base, tuple(self.keys)):
                known, place = self.keys[n]
                j = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[j] == key
                hits.append(row[at[hit]] * self.size + place[j[hit]])
        both, n = np.unique(np.concatenate(hits), return_counts=True)
        return both // self.size, both % self.size, n


def _lists(rows: np.ndarray, n_rows: int, values: pa.Array) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def _passed(piece: pa.RecordBatch, keep: list[str]) -> list[pa.Array]:
    return [piece.column(c) for c in keep]


def tfidf_vectors(tokens: DataFrame, terms: list[str], idf: list[float], sources: list[str], keep: list[str], lengths: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``keep`` and ``features``, a sparse vector in MLlib's stored form: TF-IDF of the terms (sublinear, length 1), then one place for
    each of ``sources`` with 1 at the row's ``source``."""
    look, weight, size, own_place = Lookup(terms, lengths), np.array(idf, float), len(terms) + len(sources), len(terms)

    def build(batches):
        place = pa.array(sources, pa.string())
        for batch in batches:
            for piece in _pieces(batch):
                m = piece.num_rows
                row, i, n = look.found(piece.column("words"))
                x = (np.log(n) + 1.0) * weight[i]
                value = x / np.sqrt(np.bincount(row, x * x, minlength=m))[row]
                ends = np.cumsum(np.bincount(row, minlength=m))
                own = pc.index_in(piece.column("source").cast(pa.string()), value_set=place).to_numpy(zero_copy_only=False).astype(np.int64)
                i, value, row = np.insert(i, ends, own_place + own), np.insert(value, ends, 1.0), np.insert(row, ends, np.arange(m))
                vector = pa.StructArray.from_arrays(
                    [pa.array(np.zeros(m, np.int8)), pa.array(np.full(m, size, np.int32)), _lists(row, m, pa.array(i.astype(np.int32))), _lists(row, m, pa.array(value))], ["type", "size", "indices", "values"]
                )
                yield pa.RecordBatch.from_arrays([*_passed(piece, keep), vector], [*keep, "features"])

    kinds = dict(tokens.dtypes)
    return tokens.select(*keep, "source", "words").mapInArrow(build, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", features {VECTOR}")


def weighted_sums(tokens: DataFrame, terms: list[str] | pa.Array, weights: np.ndarray, names: list[str], keep: list[str], lengths: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``keep`` and, for each of ``names``, the sum of the whole-numbered ``weights`` (a row a term, a column a name) over an entry's occurrences."""

    look = Lookup(terms, lengths)

    def add(batches):
        for batch in batches:
            for piece in _pieces(batch):
                row, i, n = look.found(piece.column("words"))
                out = np.zeros((piece.num_rows, len(names)), np.int64)
                if len(row):
                    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    out[row[first]] = np.add.reduceat(weights[i] * n[:, None], first, axis=0)
                yield pa.RecordBatch.from_arrays([*_passed(piece, keep), *[pa.array(out[:, j].copy()) for j in range(len(names))]], [*keep, *names])

    kinds = dict(tokens.dtypes)
    return tokens.select(*keep, "words").mapInArrow(add, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{c}` long" for c in names]))


def largest_products(vectors: DataFrame, coefficients: np.ndarray, names: list[str], classes: list[str], n: int, least: float, digits: int = 4) -> DataFrame:
    """The key and ``c``: of coefficient times value for the row's ``class``, those among the ``n`` largest by amount that exceed ``least``,
    with all that rounding to ``digits`` could bring among them."""
    slack = 1.01 * 10.0**-digits

    def best(batches):
        label, feature = pa.array(classes, pa.string()), pa.array(names, pa.string())
        for batch in batches:
            m, f = batch.num_rows, batch.column("features")
            own = pc.fill_null(pc.index_in(batch.column("class").cast(pa.string()), value_set=label), -1).to_numpy(zero_copy_only=False)
            at, x = pc.struct_field(f, "indices"), pc.struct_field(f, "values")
            row = np.repeat(np.arange(m), pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False))
            i, x = at.flatten().to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False)
            c = np.where(own[row] >= 0, x * coefficients[own[row], i], 0.0)
            some = np.flatnonzero(np.abs(c) > least)
            order = some[np.lexsort((-np.abs(c[some]), row[some]))]
            r, i, c = row[order], i[order], c[order]
            starts = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=m))])
            nth = np.minimum(starts[:-1] + n, starts[1:]) - 1
            low = np.zeros(m)
            full = starts[1:] - starts[:-1] >= n
            low[full] = np.abs(c[nth[full]]) - slack
            kept = np.abs(c) >= low[r]
            r, i, c = r[kept], i[kept], c[kept]
            lists = _lists(r, m, pa.StructArray.from_arrays([feature.take(pa.array(i)), pa.array(c)], ["feature", "weight"]))
            yield pa.RecordBatch.from_arrays([*_passed(batch, KEY), lists], [*KEY, "c"])

    kinds = dict(vectors.dtypes)
    return vectors.select(*KEY, "class", "features").mapInArrow(best, ", ".join(f"`{c}` {kinds[c]}" for c in KEY) + ", c array<struct<feature:string,weight:double>>")

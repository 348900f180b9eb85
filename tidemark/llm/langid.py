"""Missing or wrong language labels, and texts in several languages (problem 4).

Method: prediction by partial matching.  Each language has a byte context tree of variable order (up to
``ORDER`` bytes): a symbol seen in a context costs ``count / (total + distinct)``, one not seen costs the
escape ``distinct / (total + distinct)`` and is asked of the next shorter context, down to a uniform byte.  After
training the statistics are frozen, so the exact code length of a word, read with a blank on either
side, is one fixed number for each language and is computed once for each distinct word.

A text is a row of words; a Viterbi pass picks each word's language by code length with a cost for a
change (smaller at the bounds of sentences and quotations).  Figures cost nothing in any language and the cost
of one word is limited, so names go with what surrounds them.

Training reads a bounded sample: up to ``PER_LANGUAGE`` labelled records of each language, by a hash of the key;
records that the trees themselves file elsewhere are dropped and the trees trained again.  Everything
else covers all records in one narrow pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import spread

ORDER = 4
PER_LANGUAGE = 1500
LIMIT = 8.0  # nats one word can speak against a language
CHANGE, CHANGE_AT_BOUND = 14.0, 8.0
_RUN = re.compile(r"[^\W\d_]+")
_ENDS = tuple(".!?:;»”)\"")
_STARTS = tuple("«“„(\"")


class ContextTrees:
    """PPM trees of several languages over one table of byte strings.

    ``at`` numbers every byte string (context and symbol) met in training; ``cost`` has its log-probability in
    each language, ``escape`` what it costs, as a context, to escape from it.
    """

    def __init__(self, at: dict[bytes, int], cost: np.ndarray, escape: np.ndarray, order: int) -> None:
        self.at, self.cost, self.escape, self.order = at, cost, escape, order
        self.width = cost.shape[1]
        self.none = np.full(self.width, -np.log(256.0))

    @classmethod
    def train(cls, words: list[Counter], order: int = ORDER) -> ContextTrees:
        """``words[l]``: how often language l has each word (lower case)."""
        n = len(words)
        counts: dict[bytes, np.ndarray] = {}
        for lang, bag in enumerate(words):
            for w, c in bag.items():
                b = f" {w} ".encode("utf-8", "surrogatepass")
                for i in range(1, len(b)):
                    for k in range(min(order, i) + 1):
                        g = b[i - k : i + 1]
                        row = counts.get(g)
                        if row is None:
                            row = counts[g] = np.zeros(n)
                        row[lang] += c
        grams = sorted(counts, key=lambda g: (len(g), g))
        at = {g: i for i, g in enumerate(grams)}
        count = np.stack([counts[g] for g in grams]) if grams else np.zeros((0, n))
        total = np.zeros((len(grams) + 1, n))
        distinct = np.zeros((len(grams) + 1, n))  # the last row is the empty context
        parent = np.array([at.get(g[:-1], -1) if len(g) > 1 else len(grams) for g in grams], np.int64)
        # a context may itself never have been a predicted string (it starts with the opening blank)
        extra: dict[bytes, int] = {}
        for i, g in enumerate(grams):
            if parent[i] < 0:
                parent[i] = extra.setdefault(g[:-1], len(grams) + 1 + len(extra))
        total = np.vstack([total, np.zeros((len(extra), n))])
        distinct = np.vstack([distinct, np.zeros((len(extra), n))])
        np.add.at(total, parent, count)
        np.add.at(distinct, parent, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log(distinct / (total + distinct)), 0.0)
            own = np.log(count / (total[parent] + distinct[parent]))
        cost = np.zeros((len(grams), n))
        for i, g in enumerate(grams):
            shorter = cost[at[g[1:]]] if len(g) > 1 else np.full(n, -np.log(256.0))
            cost[i] = np.where(count[i] > 0, own[i], escape[parent[i]] + shorter)
        at = at | {b"": len(grams)} | {g: i for g, i in extra.items()}
        pad = np.zeros((len(escape) - len(cost), n))
        return cls(at, np.vstack([cost, pad]).astype(np.float32), escape.astype(np.float32), order)

    def word(self, word: str) -> np.ndarray:
        """Log-probability (minus the code length in nats) of a word in every language."""
        b = f" {word} ".encode("utf-8", "surrogatepass")
        seen, fled, at, limit, unknown = [], [], self.at, len(self.cost), 0
        top = self.at[b""]
        for i in range(1, len(b)):
            for k in range(min(self.order, i), -1, -1):
                row = at.get(b[i - k : i + 1], limit)
                if row < top:
                    seen.append(row)
                    break
                row = at.get(b[i - k : i])
                if row is not None:
                    fled.append(row)
            else:
                unknown += 1
        return self.cost[seen].sum(0) + self.escape[fled].sum(0) + unknown * self.none


class Labeller:
    """Words to languages. ``langs`` are the two-letter names in the trees' order."""

    def __init__(self, trees: ContextTrees, langs: list[str]) -> None:
        self.trees, self.langs = trees, langs
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.marks: list[int] = []

    def _new(self, token: str) -> int:
        i = self.ids[token] = len(self.rows)
        parts = _RUN.findall(token.lower())
        s = sum((self.trees.word(p) for p in parts), np.zeros(len(self.langs), np.float32))
        self.rows.append(np.maximum(s - s.max(), -LIMIT).astype(np.float32))
        is_word = any(ch.isalnum() for ch in token)
        self.marks.append(1 * is_word | 2 * token.endswith(_ENDS) | 4 * token.startswith(_STARTS))
        return i

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(word count of each text, language of each word, log-probabilities of each word)``, words of all texts in a row."""
        if len(self.rows) > 1 << 19:
            self._forget()
        ids, new, flat, sizes = self.ids.get, self._new, [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            got = [x if (x := ids(w)) is not None else new(w) for w in t.replace("\n", ".\n").split()]
            flat += got
            sizes[i] = len(got)
        flat = np.array(flat, np.int64)
        marks = np.array(self.marks, np.int8)[flat] if len(flat) else np.zeros(0, np.int8)
        doc = np.repeat(np.arange(len(texts)), sizes)
        first = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else np.zeros(0, np.int64)
        bound = (marks & 4) > 0
        bound[1:] |= (marks[:-1] & 2) > 0
        keep = (marks & 1) > 0
        # a bound at a dropped mark (a lone dash or quotation sign) passes to the next word
        carried = np.zeros(len(flat), bool)
        if len(flat):
            run = np.flatnonzero(~keep)
            carried[np.minimum(run + 1, len(flat) - 1)] = True
        bound |= carried
        flat, bound, doc = flat[keep], bound[keep], doc[keep]
        sizes = np.bincount(doc, minlength=len(texts))
        del first
        score = np.stack(self.rows)[flat] if len(flat) else np.zeros((0, len(self.langs)), np.float32)
        return sizes, viterbi(score, sizes, np.where(bound, CHANGE_AT_BOUND, CHANGE).astype(np.float32)), score


def viterbi(score: np.ndarray, sizes: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Best state of every word of every text; all texts advance together, longest first."""
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    length = sizes[order]
    n, width = score.shape
    back = np.zeros((n, width), np.int8)
    path = np.zeros(n, np.int8)
    if not n:
        return path
    active = int((length > 0).sum())
    best = score[start[:active]].copy()
    final = np.zeros((active, width), np.float32)
    states = np.arange(width, dtype=np.int8)
    for t in range(1, int(length[0])):
        now = int(np.searchsorted(-length, -t, side="left"))  # texts with more than t words
        if now < active:
            final[now:active] = best[now:active]
            best, active = best[:now], now
        at = start[:active] + t
        top = best.argmax(1)
        jump = best[np.arange(active), top] - change[at]
        stay = best >= jump[:, None]
        back[at] = np.where(stay, states, top[:, None])
        best = np.where(stay, best, jump[:, None]) + score[at]
    final[:active] = best
    total = len(final)
    state = final.argmax(1).astype(np.int8)
    for t in range(int(length[0]) - 1, -1, -1):
        now = int(np.searchsorted(-length, -t, side="left"))
        now = min(now, total)
        at = start[:now] + t
        path[at] = state[:now]
        state[:now] = back[at, state[:now]]
    return path


def training_words(texts: list[str]) -> Counter:
    bag: Counter = Counter()
    for t in texts:
        bag.update(_RUN.findall(t.lower()))
    return bag


def fit(texts: list[str], labels: list[int], langs: list[str], rounds: int = 2) -> Labeller:
    """Train; drop the records whose words mostly belong elsewhere; train again on each record's own words."""
    labels = np.asarray(labels, np.int64)
    if not langs:
        return Labeller(ContextTrees({b"": 0}, np.zeros((1, 0), np.float32), np.zeros((1, 0), np.float32), ORDER), [])
    bags = [training_words([t for t, y in zip(texts, labels) if y == i]) for i in range(len(langs))]
    for r in range(rounds):
        model = Labeller(ContextTrees.train(bags), langs)
        if r + 1 == rounds:
            return model
        sizes, path, _ = model.read(texts)
        ends = np.cumsum(sizes)
        parts: list[list[str]] = [[] for _ in langs]
        for i, t in enumerate(texts):
            own = path[ends[i] - sizes[i] : ends[i]]
            if len(own) and (own == labels[i]).mean() > 0.9:
                parts[labels[i]].append(t)
        bags = [training_words(p) if p else b for p, b in zip(parts, bags)]
    return model


def labelled_sample(texts: DataFrame, labels: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """At most ``per_language`` records of each label.

    ``texts``: ``id, text``; ``labels``: ``id, lang``.  The ids are picked on the narrow label rows (a window group
    limit); so few are broadcast that only they are read from the texts.
    """
    w = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit("lang")), "id")
    few = labels.where("lang IS NOT NULL").dropDuplicates(["id"]).withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_language).select("id", "lang")
    got = texts.join(F.broadcast(few), "id").where(F.length("text") > 0).dropDuplicates(["id"]).select("id", "lang", "text").toArrow()
    order = np.argsort(got.column(0).to_numpy(), kind="stable")
    return [got.column(2)[int(i)].as_py() for i in order], [got.column(1)[int(i)].as_py() for i in order]


_SEGMENTS = "array<struct<field: string, first: int, words: int, lang: string, confidence: double>>"


_ARROW_SEGMENTS = pa.list_(pa.struct([("field", pa.string()), ("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))


def segments(df: DataFrame, model: Labeller, key: str, fields: list[str], least: int = 6) -> DataFrame:
    """``(key, words array<int>, segments)``: of each record the word count of each field, and its segments.

    A segment is a run of words of one language in one field, ``first`` counting words from 0; runs of fewer than
    ``least`` words belong to the longer neighbour's language, unless the whole field is shorter.  The confidence is
    the language's share by the segment's mean code length a word (three words' worth), between 1/languages and 1.
    Null and empty fields have no words and no segment; null keys are left out; repeated rows repeat; a model without languages
    gives counts and no segments.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((model.trees.at, model.trees.cost, model.trees.escape, model.trees.order, model.langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cost, escape, order, langs = shared.value
        if not langs:  # nothing was labelled: words are counted, no language can be told
            for b in batches:
                n = [len([w for w in (t or "").split() if any(ch.isalnum() for ch in w)]) for i in range(b.num_rows) for t in (b.column(1 + f)[i].as_py() for f in range(len(fields)))]
                w = pa.ListArray.from_arrays(pa.array((np.arange(b.num_rows + 1) * len(fields)).astype(np.int32)), pa.array(n, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), w, pa.array([[]] * b.num_rows, _ARROW_SEGMENTS)], names=["key", "words", "segments"])
            return
        m = Labeller(ContextTrees(at, cost, escape, order), langs)
        names = pa.array(langs)
        for b in batches:
            words, parts = [], []
            for f, field in enumerate(fields):
                sizes, path, score = m.read([t or "" for t in b.column(1 + f).to_pylist()])
                words.append(sizes)
                parts.append((field, *_runs(sizes, path, score, least)))
            doc = np.concatenate([p[1] for p in parts])
            order_ = np.argsort(doc, kind="stable")
            field_no = np.concatenate([np.full(len(p[1]), i) for i, p in enumerate(parts)])[order_]
            first, count, lang, conf = (np.concatenate([p[j] for p in parts])[order_] for j in (2, 3, 4, 5))
            offsets = np.r_[0, np.cumsum(np.bincount(doc, minlength=b.num_rows))].astype(np.int32)
            structs = pa.StructArray.from_arrays(
                [pa.array(fields).take(pa.array(field_no)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), names.take(pa.array(lang.astype(np.int64))), pa.array(conf.astype(np.float64))],
                names=["field", "first", "words", "lang", "confidence"],
            )
            w = pa.ListArray.from_arrays(pa.array((np.arange(b.num_rows + 1) * len(fields)).astype(np.int32)), pa.array(np.stack(words, 1).ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), w, pa.ListArray.from_arrays(pa.array(offsets), structs)], names=["key", "words", "segments"])

    cols = spread(df.select(F.col(key).cast("long").alias("key"), *fields).where("key IS NOT NULL"))
    return cols.mapInArrow(run, f"key long, words array<int>, segments {_SEGMENTS}").withColumnRenamed("key", key)


def _runs(sizes: np.ndarray, path: np.ndarray, score: np.ndarray, least: int):
    """Runs of one language: ``(text, first word, words, language, confidence)``, short runs absorbed."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes) - sizes
    lang = path.astype(np.int64)
    for _ in range(2):
        if not len(doc):
            break
        cut = np.r_[True, (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])]
        head = np.flatnonzero(cut)
        size = np.diff(np.r_[head, len(doc)])
        same_before = np.r_[False, doc[head[1:]] == doc[head[:-1]]]
        same_after = np.r_[same_before[1:], False]
        before = np.where(same_before, np.r_[0, size[:-1]], 0)
        after = np.where(same_after, np.r_[size[1:], 0], 0)
        short = (size < least) & ((before > 0) | (after > 0))
        # the longer neighbour takes the run; of two short neighbours the longer one stays
        short &= (np.maximum(before, after) > size) | ((np.maximum(before, after) == size) & same_before)
        at = np.arange(len(head))
        source = np.where(short, np.where(before >= after, at - 1, at + 1), at)
        lang = np.repeat(lang[head][source], size)
    if not len(doc):
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0)
    cut = np.r_[True, (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])]
    head = np.flatnonzero(cut)
    size = np.diff(np.r_[head, len(doc)])
    mean = np.add.reduceat(score.astype(np.float64), head, axis=0) / size[:, None] * 3
    p = np.exp(mean - mean.max(1, keepdims=True))
    conf = p[np.arange(len(head)), lang[head]] / p.sum(1)
    return doc[head], head - begin[doc[head]], size, lang[head], conf


def declared_languages(declared: DataFrame, alias: DataFrame) -> DataFrame:
    """``(id, lang)``: what each record's declared language means; null where the notation names none."""
    a = alias.select(F.col("alias").alias("__a"), "lang").dropDuplicates(["__a"])
    d = declared.select(F.col("id").cast("long").alias("id"), F.lower(F.trim("declared")).alias("__d"))
    return d.join(a, F.col("__d") == F.col("__a"), "left").groupBy("id").agg(F.min("lang").alias("lang"))


def entry_segments(entries: DataFrame, declared: DataFrame, alias: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(segments of every entry, declared languages)``; the trees are trained on a sample of the declared entries."""
    told = declared_languages(declared, alias)
    texts, names = labelled_sample(entries.select("id", F.concat_ws("\n", "title", "content").alias("text")), told)
    langs = sorted(set(names))
    model = fit(texts, [langs.index(x) for x in names], langs)
    return segments(entries, model, "id", ["title", "content"]).dropDuplicates(["id"]), told


def entry_languages(segs: DataFrame, least: int = 6) -> DataFrame:
    """``(id, lang, confidence, words)``: the languages in each entry, those with a segment of ``least`` words or more;
    where no segment has so many, the language of the longest one (the first of equals)."""
    long = F.filter("segments", lambda s: s["words"] >= least)
    longest = F.filter("segments", lambda s: s["words"] == F.array_max(F.transform("segments", lambda x: x["words"])))
    one = segs.select("id", F.explode(F.when(F.size(long) > 0, long).otherwise(F.slice(longest, 1, 1))).alias("s"))
    share = F.sum(F.col("s.confidence") * F.col("s.words")) / F.sum("s.words")
    return one.groupBy("id", F.col("s.lang").alias("lang")).agg(F.round(share, 6).alias("confidence"), F.sum("s.words").alias("words"))


def language_cases(segs: DataFrame, told: DataFrame, least: int = 6, content_words: int = 20) -> DataFrame:
    """``(id, lang)``: languages of the entries with at least ``content_words`` words of content whose declaration is
    missing, unusable or wrong, or that hold not exactly one language."""
    found = F.array_distinct(F.transform(F.filter("segments", lambda s: s["words"] >= least), lambda s: s["lang"]))
    long_enough = segs.where(F.element_at("words", 2) >= content_words).select("id", found.alias("langs"))
    joined = long_enough.join(told, "id", "left")
    right = (F.size("langs") == 1) & F.coalesce(F.col("langs")[0] == F.col("lang"), F.lit(False))
    return joined.where(~right).select("id", F.explode("langs").alias("lang"))

"""Recipes: keyword and source weights by class, kept long as ``(kind, term, class, weight decimal(18,4))``.

A recipe has at most some hundred keywords a class, set by ``top_n``; it is broadcast only when a count proves it small.
Decimal sums make scores exact and independent of order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import argmax, clip, relevance, softmax
from tidemark.functions.text import blank, full_text, ngrams, recipe_words, space_words, strip_metacharacters
from tidemark.operators.terms import weighted_sums
from tidemark.schemas import CLASSES, DECIMAL, KEY
from tidemark.session import cut

# Fixed values of the recipe operators.
CAP_WORD, CAP_PHRASE, CAP_SOURCE, FLOOR = 0.12, 0.24, 0.08, 0.01
TARGET, LEAST_MEDIAN = 2.0, 0.01
BOOST_WORD, BOOST_PHRASE, NEW_WORD, NEW_PHRASE, NEW_CLASS = 1.5, 1.8, 0.1, 0.16, 0.08
PATTERN_LEAD, PATTERN_IMPORTANT = 0.35, 0.15
BOOST_LIMIT = 1_000_000_000  # boosts compound with every mention; decimals need a bound

BROADCAST_ROWS = 100_000
#: Terms that travel to the workers as arrays, some 50 bytes each.
LOOKUP_TERMS = 1 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if a count proves the table small; otherwise the join is left to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def from_rows(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """A recipe from ``(kind, term, class, weight)``; kind is ``keyword`` or ``source``."""
    names = ["kind", "term", "class", "weight"]
    # from Arrow it is a local relation, which Catalyst folds; from Python rows every use would be a scan of its own
    local = spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(names)}))
    return local.withColumn("weight", F.col("weight").cast(DECIMAL))


def from_document(spark: SparkSession, text: DataFrame, column: str = "value") -> DataFrame:
    """A recipe from its JSON form ``{keywords: {term: {class: w}}, source_weights: {...}}``; broken JSON gives no rows."""
    weights = "map<string,map<string,double>>"
    doc = text.select(F.from_json(column, f"keywords {weights}, source_weights {weights}").alias("d"))
    parts = []
    for kind, field in (("keyword", "keywords"), ("source", "source_weights")):
        one = doc.select(F.explode(f"d.{field}").alias("term", "m")).select("term", F.explode("m").alias("class", "w"))
        parts.append(one.select(F.lit(kind).alias("kind"), "term", "class", F.round("w", 4).cast(DECIMAL).alias("weight")))
    return parts[0].unionByName(parts[1])


def to_document(recipe: DataFrame, version: int) -> DataFrame:
    """One JSON row of a recipe, terms and classes in order."""
    per_term = recipe.groupBy("kind", "term").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", F.col("weight").cast("double"))))).alias("m"))
    pick = lambda k: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("term", F.to_json("m").alias("j"))))))
    doc = per_term.agg(pick("keyword").alias("k"), pick("source").alias("s"))
    nested = lambda c: F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"])), ","), F.lit("}"))
    return doc.select(F.concat(F.lit(f'{{"version":{version},"keywords":'), nested(F.col("k")), F.lit(',"source_weights":'), nested(F.col("s")), F.lit("}")).alias("value"))


def entry_terms(entries: DataFrame, tokenizer: str = "recipe", text: Column | None = None) -> DataFrame:
    """``(key, term, n)``: how often each word, pair and triple occurs in each entry.

    Counted before any join: of all that a text blows up into, one row a distinct term leaves the task.
    """
    words = (recipe_words if tokenizer == "recipe" else space_words)(text if text is not None else full_text())
    terms = exploded(entries.select(*KEY, words.alias("w")), ngrams(F.col("w")), *KEY).where("term IS NOT NULL")
    return terms.groupBy(*KEY, "term").agg(F.count("*").alias("n"))


def exploded(df: DataFrame, terms: Column, *keep: str) -> DataFrame:
    """One row a term. The outer form keeps Catalyst from adding a filter on the array's size, which would build every
    array twice; a row without terms has a null one."""
    return df.select(*keep, F.explode_outer(terms).alias("term"))


def hits(entries: DataFrame, recipe: DataFrame, tokenizer: str = "recipe") -> DataFrame:
    """``(key, term, n, class, weight)``: the recipe's keywords that occur in each entry.

    A broadcast recipe is joined to the exploded terms before they are counted, so only hits are shuffled.
    """
    words = (recipe_words if tokenizer == "recipe" else space_words)(full_text())
    terms = exploded(entries.select(*KEY, words.alias("w")), ngrams(F.col("w")), *KEY)
    keywords = recipe.where("kind = 'keyword'").select("term", "class", "weight")
    wanted = keywords.select("term").distinct()
    found = terms.join(small(wanted), "term", "left_semi").groupBy(*KEY, "term").agg(F.count("*").alias("n"))
    return found.join(small(keywords), "term")


def class_scores(entries: DataFrame, recipe: DataFrame, tokenizer: str = "recipe") -> DataFrame:
    """``(key, <one decimal column a class>)`` of every entry: keyword occurrences times weight, plus the source's weight."""
    zero = F.lit(0).cast(DECIMAL)
    per = hits(entries, recipe, tokenizer).groupBy(*KEY).agg(*[_by_class(c, (F.col("weight") * F.col("n")).cast(DECIMAL)).alias(f"__w_{c}") for c in CLASSES])
    every = _with_source(entries, recipe).join(per, KEY, "left")
    return every.select(*KEY, *[(F.coalesce(f"__w_{c}", zero) + F.coalesce(f"__s_{c}", zero)).cast(DECIMAL).alias(c) for c in CLASSES])


def _by_class(c: str, x: Column) -> Column:
    return F.sum(F.when(F.col("class") == c, x).otherwise(F.lit(0).cast(DECIMAL))).cast(DECIMAL)


def _with_source(entries: DataFrame, recipe: DataFrame, *keep: str) -> DataFrame:
    """The key, ``keep`` and what an entry's source adds to each class."""
    sources = recipe.where("kind = 'source'").groupBy(F.col("term").alias("source_type")).agg(*[_by_class(c, F.col("weight")).alias(f"__s_{c}") for c in CLASSES])
    return entries.select(*KEY, "source_type", *keep).join(small(sources), "source_type", "left")


def class_scores_of_tokens(tokens: DataFrame, recipe: DataFrame) -> DataFrame:
    """``class_scores`` of entries whose recipe words are taken apart already (key, ``source_type``, ``words``): one pass over the words,
    with no shuffle; None for a recipe of more than ``LOOKUP_TERMS`` keywords."""
    # ten-thousandths, so sums are exact
    whole = lambda c: F.coalesce(F.sum(F.when(F.col("class") == c, (F.col("weight") * 10_000).cast("long"))), F.lit(0)).alias(c)
    rows = recipe.where("kind = 'keyword'").groupBy("term").agg(*[whole(c) for c in CLASSES]).limit(LOOKUP_TERMS + 1).toArrow()
    if rows.num_rows > LOOKUP_TERMS:
        return None
    terms, weights = rows["term"].combine_chunks().cast(pa.string()), np.column_stack([rows[c].to_numpy() for c in CLASSES])
    sums = [f"__n_{c}" for c in CLASSES]
    per = weighted_sums(tokens, terms, weights, sums, [*KEY, "source_type"])
    zero, unit = F.lit(0).cast(DECIMAL), F.lit("0.0001").cast("decimal(4,4)")
    every = _with_source(per, recipe, *sums)
    return every.select(*KEY, *[((F.col(f"__n_{c}").cast("decimal(19,0)") * unit).cast(DECIMAL) + F.coalesce(f"__s_{c}", zero)).cast(DECIMAL).alias(c) for c in CLASSES])


def recipe_scores(entries: DataFrame, recipe: DataFrame, tokenizer: str = "recipe") -> DataFrame:
    """``(key, relevance_score, predicted_label, p_<class>)``; an entry without a hit has equal probabilities."""
    s = class_scores(entries, recipe, tokenizer)
    p = softmax(F.array(*[F.col(c).cast("double") for c in CLASSES]))
    s = s.withColumn("p", p)
    return s.select(
        *KEY, F.round(relevance(F.col("p")), 4).alias("relevance_score"), argmax(F.array(*[F.col(c) for c in CLASSES])).alias("predicted_label"),
        *[F.round(F.col("p")[i], 4).alias(f"p_{c}") for i, c in enumerate(CLASSES)],
    )


def quality(scores_a: DataFrame, scores_b: DataFrame, least: int = 2) -> DataFrame:
    """Pearson correlation of two scorings of the same entries, never below 0; 0 for fewer than ``least`` rows or no spread."""
    j = scores_a.select(*KEY, F.col("relevance_score").alias("a")).join(scores_b.select(*KEY, F.col("relevance_score").alias("b")), KEY)
    r = F.coalesce(F.nanvl(F.corr("a", "b"), F.lit(0.0)), F.lit(0.0))
    return j.agg(F.when(F.count("*") < least, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.round(r, 4))).alias("quality"), F.count("*").alias("n"))


def upper_median(scores: DataFrame) -> DataFrame:
    """The element ``n // 2`` of the sorted positive magnitudes (largest absolute class score of each entry); one row.

    Counts of equal magnitudes are added up in two steps, first by whole numbers and then within the one that holds the
    element, so no task orders all entries.
    """
    m = scores.select(F.greatest(*[F.abs(c) for c in CLASSES]).alias("m")).where("m > 0")
    counts = m.groupBy("m").agg(F.count("*").alias("n")).withColumn("b", F.floor("m").cast("long"))
    coarse = counts.groupBy("b").agg(F.sum("n").alias("bn")).withColumn("before", F.sum("bn").over(Window.orderBy("b")) - F.col("bn"))
    place = F.floor(F.sum("bn").over(Window.partitionBy()) / 2)
    home = coarse.withColumn("place", place).where("before <= place AND place < before + bn")
    fine = counts.join(home, "b").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("b").orderBy("m")))
    return fine.where("upto > place").agg(F.min("m").alias("median"))


def normalise(recipe: DataFrame, median: DataFrame) -> DataFrame:
    """Weights times ``TARGET / median``, rounded to four places; unchanged without a median of ``LEAST_MEDIAN`` or more."""
    m = median.first()["median"]
    scale = TARGET / float(m) if m is not None and float(m) >= LEAST_MEDIAN else 1.0
    return recipe.select("kind", "term", "class", F.round(F.col("weight").cast("double") * scale, 4).cast(DECIMAL).alias("weight"))


def stabilise(recipe: DataFrame) -> DataFrame:
    """Weights held within their caps (word, phrase, source); what is then below ``FLOOR`` is dropped."""
    cap = F.when(F.col("kind") == "source", CAP_SOURCE).when(F.instr("term", " ") > 0, CAP_PHRASE).otherwise(CAP_WORD).cast(DECIMAL)
    return recipe.withColumn("weight", clip(F.col("weight"), cap).cast(DECIMAL)).where(F.abs("weight") >= F.lit(FLOOR).cast(DECIMAL))


# Words that tell nothing alone (German, English, French, Italian).
LOW_SIGNAL = """
der die das den dem des ein eine einer einem einen und oder aber in im am an auf aus von
mit ohne zu zum zur für ist sind war waren wird werden nach bei als auch wie was wo wenn dass
the a an and or but to of in on at for with by from is are was were be been being that this
le la les de des du un une et ou dans sur pour avec sans est sont été ce cette ces
il lo gli i l di del della dei delle un una e o in su per con senza è sono era che
""".split()

# Phrases every recipe gets on top, and by how much in which class.
TEMPLATE_PHRASES = [
    ("third country", "investigation_lead", "0.45"), ("third country", "important", "0.25"),
    ("third countries", "investigation_lead", "0.45"), ("third countries", "important", "0.25"),
    ("pays tiers", "investigation_lead", "0.45"), ("pays tiers", "important", "0.25"),
    ("drittstaaten", "investigation_lead", "0.45"), ("drittstaaten", "important", "0.25"),
    ("member states only", "investigation_lead", "0.55"), ("member states only", "important", "0.2"),
    ("eu eea", "investigation_lead", "0.45"), ("eu eea", "important", "0.2"),
    ("eu ewr", "investigation_lead", "0.45"), ("eu ewr", "important", "0.2"),
    ("market access", "investigation_lead", "0.35"), ("market access", "important", "0.25"),
    ("single market", "important", "0.25"), ("single market", "background", "0.12"),
    ("internal market", "important", "0.22"), ("internal market", "background", "0.1"),
    ("equivalence decision", "investigation_lead", "0.35"), ("equivalence decision", "important", "0.2"),
    ("conformity assessment", "important", "0.35"), ("conformity assessment", "investigation_lead", "0.18"),
    ("ce marking", "important", "0.25"), ("ce marking", "background", "0.1"),
    ("technical regulation", "important", "0.22"), ("technical regulation", "background", "0.12"),
    ("compliance requirement", "important", "0.28"), ("compliance requirement", "background", "0.1"),
    ("implementing act", "noise", "0.35"), ("implementing act", "background", "0.12"),
    ("delegated regulation", "noise", "0.28"), ("delegated regulation", "background", "0.12"),
    ("corrigendum", "noise", "0.3"), ("annex amendment", "noise", "0.3"),
    ("administrative procedure", "noise", "0.3"), ("administrative procedure", "background", "0.15"),
]

# What marks a phrase as one of law.
PHRASE_MARKERS = [
    "eu", "eea", "ewr", "third", "country", "member state", "dritt", "tiers", "conformity", "assessment", "market access",
    "equivalence", "delegated", "implementing", "corrigendum", "annex", "regulation", "directive", "ce marking", "single market",
]


def low_signal(term: str = "term") -> Column:
    """Single words of fewer than three letters, or in ``LOW_SIGNAL``."""
    return (F.instr(term, " ") == 0) & ((F.length(term) < 3) | F.col(term).isin(LOW_SIGNAL))


def signed_top(weights: DataFrame, n: int) -> DataFrame:
    """Of each class the ``n // 2`` largest positive and ``n - n // 2`` most negative weights; what is missing to n is filled with
    the largest of the others by absolute value. Ties by term."""
    by_class = Window.partitionBy("class")
    # only the n largest of each sign can be among them, and this rank is limited before anything is shuffled
    large = F.row_number().over(Window.partitionBy("class", "__sign").orderBy(F.abs("weight").desc(), "term"))
    few = weights.withColumn("__sign", F.signum("weight")).withColumn("__r", large).where(F.col("__r") <= n).select(*weights.columns)
    ranked = few.select(
        "*",
        F.row_number().over(by_class.orderBy(F.when(F.col("weight") > 0, 0).otherwise(1), F.col("weight").desc(), "term")).alias("rp"),
        F.row_number().over(by_class.orderBy(F.when(F.col("weight") < 0, 0).otherwise(1), F.col("weight").asc(), "term")).alias("rn"),
    )
    first = ((F.col("weight") > 0) & (F.col("rp") <= n // 2)) | ((F.col("weight") < 0) & (F.col("rn") <= n - n // 2))
    ranked = ranked.withColumn("first", first.cast("int"))
    place = F.row_number().over(by_class.orderBy(F.col("first").desc(), F.abs("weight").desc(), "term"))
    return ranked.withColumn("place", place).where(F.col("place") <= n).select(*weights.columns)


def top_keywords(recipe: DataFrame, n: int) -> DataFrame:
    """Of each class the n keywords of largest absolute weight with their rank."""
    w = Window.partitionBy("class").orderBy(F.abs("weight").desc(), "term")
    return recipe.where("kind = 'keyword'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("class", "rank", "term", "weight")


def compare(old: DataFrame, new: DataFrame, n: int = 30, shift: float = 0.05) -> DataFrame:
    """``(class, term, change, old_weight, new_weight)``: keywords of the top n that came, went, or moved by more than ``shift``."""
    a = top_keywords(old, n).select("class", "term", F.col("weight").alias("old_weight"))
    b = top_keywords(new, n).select("class", "term", F.col("weight").alias("new_weight"))
    change = (
        F.when(F.col("old_weight").isNull(), "new").when(F.col("new_weight").isNull(), "removed").when(F.abs(F.col("new_weight") - F.col("old_weight")) > F.lit(shift).cast(DECIMAL), "shifted")
    )
    return a.join(b, ["class", "term"], "full").withColumn("change", change).where("change IS NOT NULL").select("class", "term", "change", "old_weight", "new_weight")


def phrase_markers(recipe: DataFrame, markers: list[str] = PHRASE_MARKERS, n: int = 12) -> DataFrame:
    """Phrases of the recipe that contain a marker: ``side`` positive (lead plus 0.7 important) and negative (noise), the top n each."""
    w = recipe.where("kind = 'keyword' AND instr(term, ' ') > 0").groupBy("term").agg(
        *[F.sum(F.when(F.col("class") == c, F.col("weight")).otherwise(F.lit(0).cast(DECIMAL))).alias(c) for c in CLASSES]
    )
    w = w.where(F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(F.col("term"), m)))
    sides = F.array(
        F.struct(F.lit("positive").alias("side"), (F.col("investigation_lead") + F.col("important") * F.lit(0.7).cast("decimal(2,1)")).cast(DECIMAL).alias("score")),
        F.struct(F.lit("negative").alias("side"), F.col("noise").cast(DECIMAL).alias("score")),
    )
    s = w.select("term", F.explode(sides).alias("x")).select("x.side", "term", "x.score").where("score > 0")
    rank = F.row_number().over(Window.partitionBy("side").orderBy(F.col("score").desc(), "term"))
    return s.withColumn("rank", rank).where(F.col("rank") <= n)


def add_priors(recipe: DataFrame, priors: DataFrame) -> DataFrame:
    """A recipe with further weights added term by term (union and sum)."""
    return recipe.unionByName(priors.select(*recipe.columns)).groupBy("kind", "term", "class").agg(F.sum("weight").cast(DECIMAL).alias("weight"))


def template_priors(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """The template phrases and the user's own patterns, to be added to a recipe."""
    fixed = from_rows(spark, [("keyword", t, c, w) for t, c, w in TEMPLATE_PHRASES])
    return fixed.unionByName(pattern_priors(spark, patterns)) if patterns else fixed


def pattern_priors(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """What a user's patterns add to a recipe as phrases; patterns of one character name nothing."""
    named = spark.createDataFrame([(p,) for p in dict.fromkeys(x.strip().lower() for x in patterns)], "p string").where(F.length("p") >= 2)
    t = named.select(strip_metacharacters(F.col("p")).alias("term")).where("term != ''")
    w = F.explode(F.map_from_arrays(F.array(F.lit(CLASSES[0]), F.lit(CLASSES[1])), F.array(F.lit(PATTERN_LEAD), F.lit(PATTERN_IMPORTANT))))
    return t.select(F.lit("keyword").alias("kind"), "term", w.alias("class", "w")).select("kind", "term", "class", F.col("w").cast(DECIMAL).alias("weight"))


def reasoning_boost(recipe: DataFrame, reasons: DataFrame) -> DataFrame:
    """Weights after the users' reasons: every mention, newest reason first, multiplies a term's weight in the reason's class
    (word 1.5, phrase 1.8), rounded to four places each time; terms and classes not in the recipe start with fixed weights.

    ``reasons``: ``label, reasoning, updated_at`` and the key.  Mentions are counted by term, class and reason before they are
    gathered, and a term's fold needs only its own mentions in order.
    """
    r = reasons.where(blank("reasoning") != "").select("label", "updated_at", *KEY, ngrams(recipe_words(F.col("reasoning")), (1, 2, 3)).alias("t"))
    per = exploded(r, F.col("t"), "label", "updated_at", *KEY).where((F.instr("term", " ") > 0) | (F.length("term") >= 3)).groupBy("label", "updated_at", *KEY, "term").agg(F.count("*").alias("n"))
    per = cut(per)
    # the class of a term's first mention (newest reason, then key): two sums instead of an order of all its mentions
    each = per.groupBy("term", "updated_at").agg(F.min(F.struct(*KEY, "label")).alias("m"))
    opener = each.groupBy("term").agg(F.max_by("m.label", F.struct(F.col("updated_at").isNotNull(), "updated_at")).alias("opener"))
    many = per.groupBy("term", F.col("label").alias("class")).agg(F.sum("n").alias("n")).join(opener, "term")
    old = recipe.where("kind = 'keyword'").select("term", "class", "weight")
    known = old.select("term").distinct().withColumn("known", F.lit(True))
    j = many.join(known, "term", "left").join(old, ["term", "class"], "full")
    phrase = F.instr("term", " ") > 0
    dec = lambda x: F.lit(x).cast(DECIMAL)
    boost = F.when(phrase, dec(BOOST_PHRASE)).otherwise(dec(BOOST_WORD))
    opens = F.col("weight").isNull() & F.col("known").isNull() & (F.col("opener") == F.col("class"))
    start = F.coalesce(F.col("weight"), F.when(opens, F.when(phrase, dec(NEW_PHRASE)).otherwise(dec(NEW_WORD))).otherwise(dec(NEW_CLASS)))
    # the first mention of a new term sets its base and multiplies nothing; no weight needs more steps to reach the limit
    steps = F.least(F.lit(200), F.coalesce("n", F.lit(0)) - F.coalesce(opens.cast("int"), F.lit(0))).cast("int")
    mentions = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    folded = F.aggregate(mentions, start.cast(DECIMAL), lambda a, _: F.greatest(dec(-BOOST_LIMIT), F.least(dec(BOOST_LIMIT), F.round(a * boost, 4))).cast(DECIMAL))
    boosted = j.select(F.lit("keyword").alias("kind"), "term", "class", folded.alias("weight"))
    return boosted.unionByName(recipe.where("kind != 'keyword'").select("kind", "term", "class", "weight"))


def contributions(entries: DataFrame, recipe: DataFrame, scores: DataFrame, n: int = 8, least: float = 0.001) -> DataFrame:
    """``(key, rank, term, contribution, direction)``: what each recipe phrase adds to an entry's predicted class, multiplicity
    counted, the n largest by absolute value."""
    h = hits(entries, recipe).join(scores.select(*KEY, F.col("predicted_label").alias("class")), [*KEY, "class"])
    c = h.select(*KEY, "term", (F.col("weight") * F.col("n")).cast(DECIMAL).alias("contribution")).where(F.abs("contribution") > F.lit(least).cast(DECIMAL))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.abs("contribution").desc(), "term"))
    direction = F.when(F.col("contribution") > 0, "positive").otherwise("negative")
    return c.withColumn("rank", rank).where(F.col("rank") <= n).select(*KEY, "rank", "term", "contribution", direction.alias("direction"))

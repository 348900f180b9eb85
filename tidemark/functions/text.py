"""String functions as column expressions; nothing here starts a Python worker unless said so."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words of a recipe: two or more Latin letters or digits between word bounds.
RECIPE_WORD = r"(?U)\b[a-zA-Z0-9À-ɏ]{2,}\b"


def blank(c: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def slugify(c: Column) -> Column:
    """Lower case, runs of anything but letters a-z and digits to one dash, no dash at the ends; empty or null: ``default``."""
    s = F.regexp_replace(F.lower(F.trim(blank(c))), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit("default"))


def url_identity(c: Column, prefix: str = "") -> Column:
    """``struct(display, slug)`` of a site's address: its last path part without ``index.php`` and the product ``prefix``, else
    its host without ``www.``; an address that names no host gives nulls."""
    s = F.trim(blank(c))
    full = F.when(s.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), s).otherwise(F.concat(F.lit("https://"), s))
    host = F.regexp_replace(F.lower(F.regexp_extract(full, r"^[^:]+://(?:[^/@]*@)?([^/:?#]+)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(full, r"^[^:]+://[^/?#]+([^?#]*)", 1), r"(?i)/index\.php/?$", "")
    last = F.regexp_extract(path, r"([^/]+)/*$", 1)
    if prefix:
        last = F.regexp_replace(last, f"(?i)^{re.escape(prefix)}", "")
    name = F.nullif(F.coalesce(F.nullif(last, F.lit("")), host), F.lit(""))
    return F.when(s != "", F.struct(name.alias("display"), F.when(name.isNotNull(), slugify(name)).alias("slug")))


def recipe_words(c: Column) -> Column:
    """Array of the recipe words of a text, in order, lower case."""
    return F.regexp_extract_all(F.lower(blank(c)), F.lit(RECIPE_WORD), F.lit(0))


def space_words(c: Column) -> Column:
    """Array of what white space separates, lower case (punctuation sticks); blank or null: empty."""
    s = F.regexp_replace(F.lower(blank(c)), r"^\s+|\s+$", "")
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, r"\s+"))


def ngrams(words: Column, lengths: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Bag of the word sequences of the given lengths, joined by single spaces."""
    parts = []
    for n in lengths:
        if n == 1:
            parts.append(words)
            continue
        parts.append(_windows(words, n))
    return F.concat(*parts)


def _windows(words: Column, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def full_text(title: str = "title", description: str = "description", content: str = "content") -> Column:
    """The three texts with single spaces, null as empty."""
    return F.concat_ws(" ", blank(title), blank(description), blank(content))


# Longest parts of the model's input text.
CONTENT_CAP, NAME_CAP, CATEGORY_CAP, SIGNAL_CAP = 500, 120, 80, 8


def signals(text: Column, patterns: list[str]) -> Column:
    """The patterns that occur in a text, in their order, distinct, at most ``SIGNAL_CAP``; a pattern that is no regular
    expression is taken literally; case is ignored."""
    kept = list(dict.fromkeys(p.strip() for p in patterns if p and p.strip()))
    if not kept:
        return F.array().cast("array<string>")
    hits = []
    for p in kept:
        try:
            re.compile(p)
            rx = p
        except re.error:
            rx = re.escape(p)
        hits.append(F.when(text.rlike(f"(?iu){rx}"), F.lit(p)))
    return F.slice(F.array_compact(F.array(*hits)), 1, SIGNAL_CAP)


def model_text(patterns: list[str] = ()) -> Column:
    """What a model reads of an entry: a head of ``key=value`` parts, a blank line, the title twice, description, content."""
    head = F.concat_ws(
        "; ",
        F.when(F.trim(blank("source_type")) != "", F.concat(F.lit("source_type="), F.trim("source_type"))),
        F.when(F.trim(blank("source_name")) != "", F.concat(F.lit("source="), F.substring(F.trim("source_name"), 1, NAME_CAP))),
        F.when(F.trim(blank("source_category")) != "", F.concat(F.lit("category="), F.substring(F.trim("source_category"), 1, CATEGORY_CAP))),
        F.when(F.size(signals(full_text(), list(patterns))) > 0, F.concat(F.lit("signals="), F.array_join(signals(full_text(), list(patterns)), ", "))),
    )
    parts = [F.nullif(F.trim(blank(c)), F.lit("")) for c in ("title", "title", "description")]
    body = F.concat_ws("\n", *parts, F.nullif(F.substring(F.trim(blank("content")), 1, CONTENT_CAP), F.lit("")))
    body = F.when(body == "", F.lit("(empty)")).otherwise(body)
    return F.when(head == "", body).otherwise(F.concat(head, F.lit("\n\n"), body))


def strip_metacharacters(c: Column) -> Column:
    """A pattern as a phrase: regular-expression signs removed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(blank(c), r"[\\^$.|?*+()\[\]{}]", "")))


def decode_feature(c: Column) -> Column:
    """The source behind an encoded feature name (``source_type_x`` or ``x0_x``), else null."""
    return F.nullif(F.regexp_extract(c, r"^(?:source_type_|x0_)(.+)$", 1), F.lit(""))


def label_display(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def shorten(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def hex_colour(c: Column) -> Column:
    """``#rrggbb`` in lower case from ``#rgb`` or ``#rrggbb``; anything else null."""
    s = F.lower(F.trim(blank(c)))
    return F.when(s.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(s, "([0-9a-f])", "$1$1")).when(s.rlike("^#[0-9a-f]{6}$"), s)


def contrast(c: Column) -> Column:
    """Black or white, whichever reads better on a ``#rrggbb`` colour (luminance above 0.55 of 1: black)."""
    part = lambda i: F.conv(F.substring(c, i, 2), 16, 10).cast("int")
    light = part(2) * 299 + part(4) * 587 + part(6) * 114
    return F.when(c.isNull(), None).when(light > 140_250, F.lit("#000000")).otherwise(F.lit("#ffffff"))


def fenced_json(c: Column) -> Column:
    """The outermost braces of a reply, with or without a Markdown fence around them; null without braces."""
    return F.nullif(F.regexp_extract(blank(c), r"(?s)\{.*\}", 0), F.lit(""))


def drop_trailing_commas(c: Column) -> Column:
    return F.regexp_replace(c, r",\s*([}\]])", "$1")


@F.pandas_udf(StringType())
def strip_accents(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition without combining marks (vectorised; the only Python in this module)."""
    for s in parts:
        yield s.map(lambda t: None if t is None else "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch)))


def analysed_words(c: Column) -> Column:
    """Lower-cased words of two or more word characters after accent stripping, for TF-IDF."""
    return F.regexp_extract_all(F.lower(strip_accents(blank(c))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))

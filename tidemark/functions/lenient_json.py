"""JSON objects out of replies that are almost JSON.

The built-in repairs come first and stay in the JVM; only what no built-in repair makes valid goes to a vectorised
function with a lenient reader (missing commas, unclosed strings, lists and objects).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.text import blank, drop_trailing_commas, fenced_json

#: White space, separators, brackets, whole strings, a string the end of the text cuts off, and bare values.
_TOKEN = re.compile(r"""\s+|[,:{}\[\]]|"(?:[^"\\]|\\.)*"|"(?:[^"\\]|\\.)*\\?\Z|[^\s,:{}\[\]"]+""", re.S)


class _Unreadable(ValueError):
    pass


def read_object(text: str) -> dict | None:
    """The first object of a text, read leniently; None where there is none or a value is no JSON.

    Commas carry no meaning, so missing and trailing ones do no harm.  A closing bracket ends the innermost container of its
    kind with all it holds, and is passed over where nothing of its kind is open.  The end of the text ends everything:
    a cut string is what is there of it, a cut bare value and a name without a value are left out.
    """
    begin = text.find("{")
    if begin < 0:
        return None
    whole: dict = {}
    open_: list[list] = []  # [container, name that waits for its value]

    def put(value: object) -> None:
        top = open_[-1]
        if isinstance(top[0], list):
            top[0].append(value)
        elif top[1] is not None:
            top[0][top[1]], top[1] = value, None
        elif isinstance(value, str):
            top[1] = value
        else:
            raise _Unreadable

    try:
        for m in _TOKEN.finditer(text, begin):
            t = m.group()
            if t in "{[":
                inner: dict | list = {} if t == "{" else []
                if open_:
                    put(inner)
                else:
                    whole = inner
                open_.append([inner, None])
            elif t in "}]":
                kind = dict if t == "}" else list
                depth = next((i for i in range(len(open_) - 1, -1, -1) if isinstance(open_[i][0], kind)), None)
                if depth is not None:
                    del open_[depth:]
                if not open_:
                    return whole
            elif t[0] == '"':
                cut = m.end() == len(text) and (len(t) == 1 or not _closed(t))
                put(json.loads(_mended(t) if cut else t, strict=False))
            elif t not in ",:" and not t.isspace():
                try:
                    put(json.loads(t))
                except _Unreadable:
                    raise
                except ValueError:
                    if m.end() < len(text):
                        return None
    except ValueError:
        return None
    return whole


def _closed(t: str) -> bool:
    """Does a string token end with its own quotation mark?"""
    return t.endswith('"') and (len(t) - 1 - len(t[:-1].rstrip("\\"))) % 2 == 0


def _mended(t: str) -> str:
    """A cut string, closed; an escape that was cut goes with the cut."""
    return re.sub(r"\\(u[0-9a-fA-F]{0,3})?\Z", "", t.rstrip()) + '"'


def repair(text: str | None) -> str | None:
    """The first object of a text as valid JSON, or None."""
    got = read_object(text) if text else None
    return None if got is None else json.dumps(got, ensure_ascii=False)


@F.pandas_udf(StringType())
def repair_json(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(repair)


def find_in(doc: object, names: tuple[str, ...], depth: int) -> str | None:
    """The first text under one of the names, outer levels before inner ones, at most ``depth`` levels deep."""
    level = [doc]
    for _ in range(depth + 1):
        for d in level:
            if isinstance(d, dict):
                for n in names:
                    if isinstance(d.get(n), str) and d[n].strip():
                        return d[n].strip()
        level = [v for d in level for v in (d.values() if isinstance(d, dict) else d if isinstance(d, list) else ()) if isinstance(v, (dict, list))]
    return None


def nested_text(c: Column, names: tuple[str, ...], depth: int = 3) -> Column:
    """A text found by name somewhere in a JSON document, null if there is none or the document is broken."""

    @F.pandas_udf(StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t):
            try:
                return find_in(json.loads(t), names, depth) if t else None
            except ValueError:
                return None

        for s in parts:
            yield s.map(one)

    return run(c)


def is_object(c: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))


def lenient_object(c: Column) -> Column:
    """A reply's JSON object as text; null where there is none."""
    t = blank(c)
    inner = fenced_json(t)
    bare = drop_trailing_commas(inner)
    return F.when(is_object(t), t).when(is_object(inner), inner).when(is_object(bare), bare).otherwise(repair_json(F.when(~is_object(bare) | bare.isNull(), t)))

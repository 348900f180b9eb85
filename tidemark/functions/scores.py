"""Probability, date and rounding functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import CLASS_WEIGHTS, CLASSES


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Stable softmax of an array; temperatures below 0.001 count as that."""
    t = F.greatest(F.lit(temperature) if not isinstance(temperature, Column) else temperature, F.lit(1e-3))
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def log_probabilities(p: Column) -> Column:
    """Logits from probabilities, floored at 1e-12."""
    return F.transform(p, lambda x: F.log(F.least(F.lit(1.0), F.greatest(F.lit(1e-12), x))))


def entropy(p: Column) -> Column:
    """Shannon entropy in bits of an array of probabilities; zeros add nothing."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0)))


def relevance(p: Column, classes: list[str] = CLASSES) -> Column:
    """Weighted sum of class probabilities given in the order of ``classes``."""
    w = F.array(*[F.lit(CLASS_WEIGHTS[c]) for c in classes])
    return F.aggregate(F.zip_with(p, w, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def lead_blend(rel: Column, p_lead: Column, blend: float) -> Column:
    """``(1 - b) rel + b p_lead`` with b between 0 and 0.25, the result between 0 and 1."""
    b = min(0.25, max(0.0, blend))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), rel * (1 - b) + p_lead * b))


def argmax(p: Column, classes: list[str] = CLASSES) -> Column:
    """The first class of the greatest probability."""
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(p, F.array_max(p)).cast("int"))


def clip(c: Column, cap: float | Column) -> Column:
    cap = F.lit(cap) if not isinstance(cap, Column) else cap
    return F.greatest(-cap, F.least(cap, c))


def parse_label_time(c: Column) -> Column:
    """Label times: a plain number of seconds, ``Y-m-d H:M:S``, ``Y-m-dTH:M:S``, ``Y-m-d``, or ISO with zone; else null. UTC."""
    s = F.trim(c)
    number = F.when(s.rlike(r"^\d+(\.\d+)?$"), F.timestamp_micros((s.try_cast("double") * 1e6).try_cast("bigint")))
    tried = [F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")]
    return F.coalesce(number, *tried)


def time_decay(updated: Column, created: Column, now: str, half_life_days: float, floor: float) -> Column:
    """``max(floor, 0.5 ** (age / half life))``; no time or no half life: 1."""
    if not half_life_days or half_life_days <= 0:
        return F.lit(1.0)
    at = F.coalesce(parse_label_time(updated), parse_label_time(created))
    age = F.greatest(F.lit(0.0), (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(at)) / 86400.0)
    return F.when(at.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(float(floor)), F.pow(F.lit(0.5), age / half_life_days)))


def temperature_grid() -> Column:
    """Forty temperatures from 0.25 to 12, evenly spaced by ratio."""
    return F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.lit(0.25) * F.pow(F.lit(48.0), i / 39.0))


def suggested_keywords(n: Column) -> Column:
    """Suggested recipe size for ``n`` labels: 200 rising to 400 at 2000."""
    return F.round(F.lit(200) + F.lit(200) * F.least(F.lit(1.0), n / 2000.0), 0).cast("int")


def day_window(now: str, days: int) -> Column:
    """The date ``days`` before ``now`` as text, for comparison with text dates."""
    return F.date_format(F.date_sub(F.lit(now).cast("date"), days), "yyyy-MM-dd")

"""Configuration: defaults, a JSON file over them, a profile's own values over both, and their limits."""

from __future__ import annotations

import json
import os
from pathlib import Path

DEFAULTS = {
    "min_labels_to_train": 20, "recipe_top_keywords": 200, "alert_threshold": 0.75, "embedding_dim": 768, "label_time_decay_days": 0, "label_time_decay_floor": 0.2,
    "reasoning_weight_boost": 1.0, "discovery_lead_blend": 0.0, "legal_signal_patterns": [], "model_architecture": "transformer", "active_profile_id": None,
}
# Least and greatest of each number.
LIMITS = {
    "min_labels_to_train": (5, 500), "recipe_top_keywords": (50, 1000), "alert_threshold": (0.0, 1.0), "label_time_decay_days": (0, 3650), "label_time_decay_floor": (0.0, 1.0),
    "reasoning_weight_boost": (0.0, 5.0), "discovery_lead_blend": (0.0, 0.25),
}
PER_PROFILE = [*LIMITS, "legal_signal_patterns", "model_architecture"]


def patterns(value: object) -> list[str]:
    """A list of trimmed, distinct, non-empty patterns in order; a single text is a list of one."""
    items = [value] if isinstance(value, str) else list(value or [])
    return list(dict.fromkeys(s for x in items if (s := str(x).strip())))


def limited(values: dict) -> dict:
    """Known numbers held within their limits; what is no number falls back to its default; a threshold of 0 means the default."""
    out = dict(values)
    for k, (low, high) in LIMITS.items():
        if k in out:
            try:
                v = float(out[k])
            except (TypeError, ValueError):
                v = float(DEFAULTS[k])
            if k == "alert_threshold" and v == 0:
                v = DEFAULTS[k]
            v = max(low, min(high, v))
            out[k] = int(v) if isinstance(low, int) else v
    if "legal_signal_patterns" in out:
        out["legal_signal_patterns"] = patterns(out["legal_signal_patterns"])
    return out


def load(path: str) -> dict:
    """The file's values over the defaults; an unreadable file or anything but an object gives the defaults."""
    try:
        got = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        got = {}
    return DEFAULTS | limited(got if isinstance(got, dict) else {})


def save(path: str, values: dict) -> None:
    """Write by replacement, so that a reader never sees half a file."""
    tmp = Path(path).with_suffix(".tmp")
    tmp.write_text(json.dumps(values, indent=2, ensure_ascii=False), encoding="utf-8")
    os.replace(tmp, path)


def effective(values: dict, profile: dict | str | None) -> dict:
    """A profile's own settings over the general ones, for the keys a profile may set."""
    if isinstance(profile, str):
        try:
            profile = json.loads(profile)
        except ValueError:
            profile = {}
    own = profile if isinstance(profile, dict) else {}
    return values | limited({k: own[k] for k in PER_PROFILE if k in own})


def set_active(values: dict, profile_id: int | None, known: set[int]) -> dict:
    """Choose a workspace; an unknown one clears the choice."""
    return values | {"active_profile_id": profile_id if profile_id in known else None}

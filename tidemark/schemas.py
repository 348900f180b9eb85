"""Fixed vocabularies and table schemas of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Label classes in declared order with their share in the relevance score.
CLASSES = ["investigation_lead", "important", "background", "noise"]
CLASS_WEIGHTS = {"investigation_lead": 1.0, "important": 0.66, "background": 0.33, "noise": 0.0}
ENTRY_TYPES = ["feed_item", "email", "lex_item", "calendar_event"]
KEY = ["entry_type", "entry_id"]
LABEL_KEY = ["profile_id", *KEY]

_s, _l, _d = T.StringType(), T.LongType(), T.DoubleType()


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


ENTRIES = _schema(
    id=_l, entry_type=_s, entry_id=_l, title=_s, description=_s, content=_s, link=_s, author=_s, published_date=_s,
    source_name=_s, source_category=_s, source_type=_s, embedding=T.ArrayType(T.FloatType()), fetched_at=_s,
)
LABELS = _schema(
    profile_id=_l, entry_type=_s, entry_id=_l, label=_s, reasoning=_s, label_source=_s, pending_job_id=_s, created_at=_s, updated_at=_s
)
REMOTE_LABELS = _schema(entry_type=_s, entry_id=_l, label=_s, reasoning=_s, labeled_at=_s)
MODELS = _schema(
    id=_l, profile_id=_l, version=_l, accuracy=_d, f1_score=_d, label_count=_l, label_distribution=_s, architecture=_s, trained_at=_s, is_active=_l
)
PROFILES = _schema(id=_l, slug=_s, display_name=_s, description=_s, accent_color=_s, is_default=_l, created_at=_s, training_settings=_s)
SYNC_LOG = _schema(id=_l, profile_id=_l, direction=_s, items_count=_l, details=_s, synced_at=_s)
DECIMAL = T.DecimalType(18, 4)

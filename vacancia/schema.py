"""The unified listing schema every source mapping emits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
LISTING = T.StructType([
    T.StructField(name, kind)
    for name, kind in [
        ("id", _TEXT), ("source", _TEXT), ("source_id", _TEXT), ("title", _TEXT), ("company", _TEXT), ("location", _TEXT),
        ("remote", T.BooleanType()), ("work_mode", _TEXT), ("employment_type", _TEXT), ("seniority", _TEXT),
        ("salary_min", T.DoubleType()), ("salary_max", T.DoubleType()), ("salary_currency", _TEXT),
        ("posted_date_raw", _TEXT), ("posted_date", T.DateType()), ("description_text", _TEXT),
        ("url", _TEXT), ("apply_url", _TEXT), ("departments", _TEXTS), ("tags", _TEXTS), ("verification_status", _TEXT),
    ]
])
_ALTERNATE = T.StructType([T.StructField(name, _TEXT) for name in ("source", "url", "source_id")])
# Columns added on the way: by the keyword score and by deduplication.
ADDED = T.StructType([
    T.StructField("preliminary_relevance_score", T.DoubleType()),
    T.StructField("matched_keywords", _TEXTS),
    T.StructField("alternate_sources", T.ArrayType(_ALTERNATE)),
])

ATS_SOURCES = ("greenhouse", "lever", "workable", "ashby")
API_SOURCES = ("remotive", "remoteok", "jobicy", "himalayas", "themuse")
FEED_SOURCES = ("rss",)
SOURCES = ATS_SOURCES + API_SOURCES + FEED_SOURCES


def conform(df: DataFrame) -> DataFrame:
    """Order and cast to `LISTING`; columns beyond it are kept behind the fixed ones."""
    fixed = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in LISTING
    ]
    names = set(LISTING.names)
    return df.select(*fixed, *[c for c in df.columns if c not in names])

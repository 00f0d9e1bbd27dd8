"""Display labels of sources and artifacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexferry import constants as C


def source_type_label(source_type: Column) -> Column:
    # Only the first occurrence of the prefix goes.
    other = F.concat(
        F.lit(C.LABEL_OTHER),
        F.regexp_replace(source_type, r"(?s)^(.*?)SOURCE_CONTENT_TYPE_", "$1"),
    )
    known = [F.when(source_type == v, text) for v, text in C.SOURCE_TYPE_LABELS.items()]
    return F.coalesce(*known, other)


def artifact_label(title: Column, artifact_type: Column) -> Column:
    short = F.regexp_replace(artifact_type, r"(?s)^(.*?)ARTIFACT_TYPE_", "$1")
    short = F.regexp_replace(short, r"(?s)^(.*?)APP_TYPE_", "$1")
    return F.concat(title, F.lit(" ("), short, F.lit(")"))


def origin_cell(source_url: Column) -> Column:
    """Origin column of the notebook index."""
    return F.when(
        source_url != "", F.concat(F.lit("["), source_url, F.lit("]("), source_url, F.lit(")"))
    ).otherwise(C.INDEX_NO_URL)


def origin_label(source_url: Column, channel: Column) -> Column:
    """Origin as shown to a reader, with the channel of a video."""
    shown = F.concat(
        F.lit(C.LABEL_URL),
        source_url,
        F.when(channel != "", F.concat(F.lit(C.LABEL_CHANNEL), channel)).otherwise(""),
    )
    return F.when(source_url != "", shown).otherwise(C.LABEL_NO_URL)

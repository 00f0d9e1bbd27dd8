"""Identity map: normalize it, keep the last row per owner, map owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexferry import constants as C
from codexferry.functions import text as T

IDENTITY_COLUMNS = list(C.IDENTITY_ALIASES)


def site_url(upn: Column, prefix: str = C.SITE_URL_PREFIX) -> Column:
    return F.concat(F.lit(prefix), upn)


def normalize_identity(
    raw: DataFrame, seq: str = "line_no", site_prefix: str = C.SITE_URL_PREFIX
) -> DataFrame:
    """Four columns from any accepted header, with fallbacks; ``seq`` is kept."""
    # Unique names first: two headers may be equal once trimmed and lower-cased.
    renamed = raw.toDF(*[f"c{i}" for i in range(len(raw.columns))])
    by_name = {name.strip().lower(): f"c{i}" for i, name in enumerate(raw.columns)}

    def field(name: str) -> Column:
        found = [
            T.nonempty(T.strip_space(F.col(by_name[a]).cast("string")))
            for a in C.IDENTITY_ALIASES[name]
            if a in by_name
        ]
        return F.coalesce(*found, F.lit(None).cast("string"))

    return (
        renamed.select(
            F.lower(field("gws_email")).alias("gws_email"),
            field("m365_upn").alias("m365_upn"),
            field("ge_target_email").alias("ge_target_email"),
            field("sharepoint_site_url").alias("sharepoint_site_url"),
            F.col(by_name[seq.lower()]).alias(seq),
        )
        .withColumn("m365_upn", F.coalesce("m365_upn", "gws_email"))
        .withColumn("ge_target_email", F.coalesce("ge_target_email", "m365_upn"))
        .withColumn(
            "sharepoint_site_url",
            F.coalesce("sharepoint_site_url", site_url(F.col("m365_upn"), site_prefix)),
        )
    )


def mapped_rows_only(identity: DataFrame) -> DataFrame:
    return identity.where(T.nonempty(F.col("gws_email")).isNotNull())


def identity_last_wins(identity: DataFrame, seq: str = "line_no") -> DataFrame:
    """One row per owner: the one with the highest ``seq``."""
    rest = [c for c in identity.columns if c != "gws_email"]
    return (
        identity.groupBy("gws_email")
        .agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
        .select("gws_email", "_last.*")
    )


def identity_map(
    raw: DataFrame, seq: str = "line_no", site_prefix: str = C.SITE_URL_PREFIX
) -> DataFrame:
    """The map that the other operators take: one row per mapped owner."""
    rows = mapped_rows_only(normalize_identity(raw, seq, site_prefix))
    return identity_last_wins(rows, seq).select(*IDENTITY_COLUMNS)


def map_identity(
    df: DataFrame,
    identity: DataFrame,
    owner: str = "owner_email",
    site_prefix: str = C.SITE_URL_PREFIX,
) -> DataFrame:
    """Add target columns by owner; unmapped owners map to themselves.

    No broadcast hint: the map grows with the organization. Spark broadcasts it
    when its measured size is below the threshold and otherwise splits hot owners
    in the sort-merge join.
    """
    target = identity.select(
        F.col("gws_email").alias(owner), *[c for c in IDENTITY_COLUMNS if c != "gws_email"]
    )
    joined = df.join(target, owner, "left")
    upn = F.coalesce(T.nonempty(F.col("m365_upn")), F.col(owner))
    return (
        joined.withColumn("m365_upn", upn)
        .withColumn(
            "ge_target_email",
            F.coalesce(T.nonempty(F.col("ge_target_email")), F.col("m365_upn")),
        )
        .withColumn(
            "sharepoint_site_url",
            F.coalesce(
                T.nonempty(F.col("sharepoint_site_url")), site_url(F.col("m365_upn"), site_prefix)
            ),
        )
    )

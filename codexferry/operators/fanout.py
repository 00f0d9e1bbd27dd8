"""Template fan-out: every mapped user gets a copy of a single owner's notebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexferry.functions import text as T
from codexferry.operators.identity import IDENTITY_COLUMNS
from codexferry.operators.notebooks import notebook_key, sharepoint_folder
from codexferry.operators.ordering import pair_all


def is_template(notebooks: DataFrame, identity: DataFrame) -> bool:
    """More than one mapped user and exactly one owner.

    This is measured before the fan-out is planned: as a filter it would make Spark
    compute the notebooks twice, once for each answer.
    """
    users = identity.agg(F.count(F.lit(1)).alias("n"))
    owners = notebooks.agg((F.min("owner_email") == F.max("owner_email")).alias("one"))
    row = owners.select("one", users.scalar().alias("users")).first()
    return bool(row["one"]) and row["users"] > 1


def _users(identity: DataFrame) -> DataFrame:
    return identity.select(*[F.col(c).alias(f"_u_{c}") for c in IDENTITY_COLUMNS])


def fan_out_template(
    notebooks: DataFrame, identity: DataFrame, template: bool | None = None
) -> DataFrame:
    """Copies per mapped user if the notebooks are a template, else no change.

    ``template`` is the answer of :func:`is_template` if it is known already.
    """
    if template is None:
        template = is_template(notebooks, identity)
    if not template:
        return notebooks
    paired = pair_all(notebooks, _users(identity), ["nb_key"], ["_u_gws_email"])
    folder = T.sanitize_filename(F.col("title"))
    owner = F.col("_u_gws_email")
    renewed = {
        "owner_email": owner,
        "m365_upn": F.col("_u_m365_upn"),
        "ge_target_email": F.col("_u_ge_target_email"),
        "sharepoint_site_url": F.col("_u_sharepoint_site_url"),
        "sharepoint_folder": sharepoint_folder(owner, folder),
        "nb_key": notebook_key(owner, folder),
    }
    return paired.select(*[renewed.get(c, F.col(c)).alias(c) for c in notebooks.columns])


def fan_out_files(
    children: DataFrame, identity: DataFrame, template: bool, kind: str | None
) -> DataFrame:
    """Children of template notebooks, one copy per mapped user.

    ``template`` is the answer of :func:`is_template` for the notebooks. With
    ``kind`` (``Sources`` or ``Notes``) the staged path moves below each user's
    folder and ``copied_from`` names the template's file: this is the copy list of
    the staging area. With ``kind=None`` a path stays the template's.
    """
    old = F.col("relative_sharepoint_path")
    if not template:
        if kind is None:
            return children
        return children.withColumn("copied_from", F.lit(None).cast("string"))
    paired = pair_all(children, _users(identity), ["nb_key", "file"], ["_u_gws_email"])
    folder = T.sanitize_filename(F.col("notebook_title"))
    owner = F.col("_u_gws_email")
    renewed = {"owner_email": owner, "nb_key": notebook_key(owner, folder)}
    copied_from = []
    if kind is not None:
        renewed["relative_sharepoint_path"] = T.join_path(
            owner, folder, F.lit(kind), T.file_name(old)
        )
        copied_from = [old.alias("copied_from")]
    return paired.select(
        *[renewed.get(c, F.col(c)).alias(c) for c in children.columns], *copied_from
    )

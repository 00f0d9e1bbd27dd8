"""Upload plan: each staged file with its place in the target library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexferry import constants as C
from codexferry.functions import text as T


def _strip_slashes(path: Column) -> Column:
    return F.btrim(path, F.lit("/"))


def drive_dir(upn: Column, sub_folder: Column, rel_dir: Column) -> Column:
    """Folder of a file below a drive's root."""
    base = _strip_slashes(F.concat_ws("/", upn, sub_folder))
    return F.when(rel_dir != "", F.concat_ws("/", base, rel_dir)).otherwise(base)


def remote_path(upn: Column, sub_folder: Column, rel_dir: Column, name: Column) -> Column:
    """Percent-encoded path of a file below a drive's root."""
    folder = _strip_slashes(drive_dir(upn, sub_folder, rel_dir))
    return T.percent_encode_path(F.concat_ws("/", folder, name))


def drive_url(drive_id: str, path: Column) -> Column:
    return F.concat(
        F.lit(C.DRIVE_URL_PREFIX + drive_id + "/root:/"), path, F.lit(":/content")
    )


def library_folder(library: Column, sub_folder: Column, rel_dir: Column) -> Column:
    """Folder of a file in a library, as it is."""
    return F.rtrim(F.concat_ws("/", library, sub_folder, rel_dir), F.lit("/"))


def staged_files(files: DataFrame, stage_root: str, path: str = "rel_path") -> DataFrame:
    """Folder key, directory below it and name of files below the staging root.

    A notebook's folder is always owner/title, so the key is derived from the path
    and the join is an equality, not a prefix match.
    """
    parts = F.split(F.col(path), "/", -1)
    depth = F.size(parts)
    return (
        files.withColumn("_parts", parts)
        .where(depth >= 3)
        .select(
            F.concat_ws(
                "/",
                F.lit(stage_root.rstrip("/")),
                F.element_at("_parts", 1),
                F.element_at("_parts", 2),
            ).alias("folder"),
            F.concat_ws("/", F.slice("_parts", 3, F.size("_parts") - 3)).alias("rel_dir"),
            F.element_at("_parts", -1).alias("file"),
            *[c for c in files.columns if c in ("length",)],
        )
    )


def upload_plan(transfer: DataFrame, files: DataFrame, drive_id: str) -> DataFrame:
    """Transfer rows with the files of their folder; a folder without files drops out.

    A folder that holds most files is split by the adaptive skew join.
    """
    upn, sub = F.col("M365_SharePoint_UPN"), F.col("TargetSubFolder")
    return transfer.withColumnRenamed("SourcePath", "folder").join(files, "folder").select(
        "folder",
        "rel_dir",
        "file",
        "TargetWebUrl",
        drive_dir(upn, sub, F.col("rel_dir")).alias("remote_dir"),
        drive_url(drive_id, remote_path(upn, sub, F.col("rel_dir"), F.col("file"))).alias("put_url"),
        library_folder(F.col("TargetDocumentLibrary"), sub, F.col("rel_dir")).alias(
            "library_folder"
        ),
        F.regexp_replace("file", r"(?s)(.)\.[^.]*\z", "$1").alias("item_title"),
    )

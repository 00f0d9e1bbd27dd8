"""Export tree to manifest and staged documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexferry import constants as C
from codexferry.functions import documents as D
from codexferry.functions import text as T
from codexferry.operators import notebooks as N
from codexferry.operators import summary as S
from codexferry.operators.docx import render_docx
from codexferry.operators.fanout import fan_out_files, fan_out_template, is_template
from codexferry.operators.identity import map_identity
from codexferry.operators.ordering import MAX_GROUP, number_rows
from codexferry.storage import materialize, together


@dataclass(frozen=True)
class Extracted:
    """What a tree holds, copy by copy; pages are parsed.

    ``errors`` are the archives and entries that could not be read: ``archive``,
    ``entry_path`` (NULL for a whole archive), ``entry_no``, ``entry_error``.
    """

    copies: DataFrame
    sources: DataFrame
    notes: DataFrame
    artifacts: DataFrame
    errors: DataFrame | None = None


@dataclass(frozen=True)
class Manifest:
    """Merged notebooks and their children, keyed by ``nb_key`` and ``position``."""

    notebooks: DataFrame
    sources: DataFrame
    notes: DataFrame
    artifacts: DataFrame
    errors: DataFrame | None = None
    # The copy list of a fan-out: ``copied_from``, ``path``.
    copied: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {
            "notebooks": self.notebooks,
            "sources": self.sources,
            "notes": self.notes,
            "artifacts": self.artifacts,
        }

    def totals(self) -> DataFrame:
        return S.manifest_totals(
            self.notebooks, self.sources, self.notes, self.artifacts, self.errors
        )

    def nested(self, size: int = S.CHUNK_ITEMS) -> DataFrame:
        return S.attach_children(self.notebooks, self.sources, self.notes, self.artifacts, size)


ERROR = ["archive", "entry_path", "entry_no", "entry_error"]
EXTRACTED = ("copies", "sources", "notes", "artifacts", "errors")


class UnreadableArchive(ValueError):
    """A whole archive could not be read."""


def extract(
    tree: DataFrame,
    default_owner: str,
    work_uri: str | None = None,
    allow_unreadable: bool = False,
) -> Extracted:
    """Find and parse everything in a tree, and write it.

    An archive that cannot be read at all raises :class:`UnreadableArchive` before
    anything is parsed, unless ``allow_unreadable``; it and every unreadable entry
    are rows of ``errors``.

    The files are written first, by kind, so that archives are unpacked once and
    each step reads its own kind. Pages are parsed once, a lost executor costs no
    second parse, and steps that need no text (all but the documents) do not read
    it. With ``work_uri`` the tables stay there and :func:`read_extracted` finds
    them, so that owners can be mapped anew without another extraction.
    """
    base = work_uri.rstrip("/") if work_uri else None
    files = materialize(N.classify_tree(tree), f"{base}/files" if base else None, by="kind")

    def kind(name: str) -> DataFrame:
        return files.where(F.col("kind") == name).drop("kind", "entry_error")

    errors = files.where("kind = 'error'").select(*ERROR)
    if not allow_unreadable:
        lost = errors.where("entry_path is null").select("archive", "entry_error").head(5)
        if lost:
            raise UnreadableArchive("; ".join(f"{r.archive}: {r.entry_error}" for r in lost))
    found = {
        "copies": N.discover_notebooks(kind("notebook"), default_owner),
        "sources": N.parse_sources(N.discover_sources(kind("source"))),
        "notes": N.discover_notes(kind("note")),
        "artifacts": N.discover_artifacts(kind("artifact")),
        "errors": errors,
    }
    # No table needs another one: they are parsed and written side by side.
    writes = [
        partial(materialize, found[n], f"{base}/{n}" if base else None) for n in EXTRACTED
    ]
    return Extracted(*together(*writes))


def read_extracted(spark: SparkSession, work_uri: str) -> Extracted:
    base = work_uri.rstrip("/")
    return Extracted(*[spark.read.parquet(f"{base}/{n}") for n in EXTRACTED])


def merge(found: Extracted, max_group: int = MAX_GROUP) -> Manifest:
    """Merge copies and number the children of each notebook.

    A notebook with more than ``max_group`` children is numbered range by range.
    """

    def numbered(children: DataFrame, order: list[str]) -> Callable[[], DataFrame]:
        return lambda: materialize(number_rows(children, ["nb_key"], order, max_group=max_group))

    notebooks = materialize(N.merge_notebooks(found.copies))
    sources = N.merge_sources(found.sources.drop("blocks"), found.copies, notebooks)
    notes = N.first_copy_children(found.notes.drop("blocks"), notebooks, "Notes")
    artifacts = N.first_copy_children(found.artifacts, notebooks, "Artifacts")
    children = together(
        numbered(sources, ["copy_path", "copy_file", "file"]),
        numbered(notes, ["copy_path", "file"]),
        numbered(artifacts, ["copy_path", "file"]),
    )
    return Manifest(notebooks, *children, found.errors)


def map_owners(
    manifest: Manifest,
    identity: DataFrame,
    stage_root: str = "",
    rewrite_note_paths: bool = False,
    site_prefix: str = C.SITE_URL_PREFIX,
) -> Manifest:
    """Map owners and fan a template out; needs no new extraction."""
    notebooks = map_identity(manifest.notebooks, identity, site_prefix=site_prefix)
    template = is_template(manifest.notebooks, identity)
    sources = fan_out_files(manifest.sources, identity, template, "Sources")
    kind = "Notes" if rewrite_note_paths else None
    notes = fan_out_files(manifest.notes, identity, template, kind)
    artifacts = fan_out_files(manifest.artifacts, identity, template, None)
    docx = T.join_path(F.lit(stage_root.rstrip("/")), F.col("relative_sharepoint_path"))
    copied = staging_copies(manifest, identity) if template else None
    return replace(
        manifest,
        notebooks=fan_out_template(notebooks, identity, template),
        sources=sources.withColumn("docx_path", docx),
        notes=notes.withColumn("docx_path", docx),
        artifacts=artifacts,
        copied=copied,
    )


def staging_copies(manifest: Manifest, identity: DataFrame) -> DataFrame:
    """``copied_from, path``: the staged folders of a template, copied for each user.

    A notebook's whole folder is copied, sources, notes and index; the manifest's notes
    keep the template's paths all the same.
    """
    old, new = F.col("copied_from"), F.col("relative_sharepoint_path").alias("path")
    sources = fan_out_files(manifest.sources, identity, True, "Sources").select(old, new)
    notes = fan_out_files(manifest.notes, identity, True, "Notes").select(old, new)
    index = T.join_path(F.col("sharepoint_folder"), F.lit(C.INDEX_FILE))
    books = manifest.notebooks.select("owner_email", "title", "nb_key", index.alias("copied_from"))
    books = books.withColumn("sharepoint_folder", F.lit(None).cast("string"))
    indexes = fan_out_template(books, identity, True).select(
        old, T.join_path(F.col("sharepoint_folder"), F.lit(C.INDEX_FILE)).alias("path")
    )
    return sources.unionByName(notes).unionByName(indexes)


def _staged(children: DataFrame, copies: DataFrame, kind: str) -> DataFrame:
    """Children of every copy with the path that their document takes."""
    path = N.staged_path(F.col("owner_email"), F.col("folder"), kind, F.col("title"))
    return (
        N.in_copies(children, copies).withColumn("kind", F.lit(kind)).withColumn("path", path)
    )


def _replaced(found: Extracted) -> DataFrame:
    """Documents that a later copy replaces, by name.

    Found on the names alone and written, so that Spark knows its size: the texts
    are not shuffled for it as long as the list can be broadcast.
    """
    names = ["root_path", "file", "title"]
    order = F.struct("root_path", "nb_file", "file")
    staged = (
        _staged(found.sources.select(*names), found.copies, "Sources")
        .unionByName(_staged(found.notes.select(*names), found.copies, "Notes"))
        .select("path", *DOCUMENT_KEY)
    )
    last = staged.groupBy("path").agg(F.max(order).alias("last"))
    lost = staged.join(last, "path").where(order != F.col("last"))
    return materialize(lost.select(*DOCUMENT_KEY))


DOCUMENT_KEY = ["kind", "root_path", "nb_file", "file"]


def document_rows(found: Extracted) -> DataFrame:
    """``path, paragraphs`` of every source and note of every copy.

    Several copies may stage one path; the last copy wins.
    """

    def styled(rows, source_type, added, url, channel) -> DataFrame:
        paragraphs = D.paragraph_styles(
            F.col("title"), source_type, F.col("owner_email"), added, url, channel, F.col("blocks")
        )
        return rows.select("path", *DOCUMENT_KEY, paragraphs.alias("paragraphs"))

    empty = F.lit("")
    sources = styled(
        _staged(found.sources, found.copies, "Sources"),
        F.col("source_type"), F.col("added_timestamp"), F.col("source_url"),
        F.col("youtube_channel"),
    )
    notes = styled(
        _staged(found.notes, found.copies, "Notes"), F.lit(C.TYPE_NOTE), F.lit(None), empty, empty
    )
    return (
        sources.unionByName(notes)
        .join(_replaced(found), DOCUMENT_KEY, "left_anti")
        .select("path", "paragraphs")
    )


def documents(found: Extracted) -> DataFrame:
    """``path, content``: the Word documents of a tree."""
    xml = document_rows(found).select(
        "path", D.document_xml(F.col("paragraphs")).alias("document_xml")
    )
    return render_docx(xml)


def staged_listing(manifest: Manifest) -> DataFrame:
    """Relative paths of all staged files: documents and indexes, and the copies of a fan-out."""
    rel = F.col("relative_sharepoint_path").alias("path")
    index = T.join_path(F.col("sharepoint_folder"), F.lit(C.INDEX_FILE)).alias("path")
    files = (
        manifest.sources.select(rel)
        .unionByName(manifest.notes.select(rel))
        .unionByName(manifest.notebooks.select(index))
    )
    if manifest.copied is not None:
        files = files.unionByName(manifest.copied.select("path"))
    return files.distinct()

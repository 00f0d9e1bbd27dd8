"""Notebook model: find notebooks and their children, merge copies.

A *tree* is a table of files: ``archive, entry_path, entry_no, content``. When
several archives hold one path, the last one (by archive, then entry) counts. An
entry that comes in parts does not fit into a value: it is an error, not a file.
A *copy* is one folder that holds a notebook; copies are ordered by path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexferry import constants as C
from codexferry.functions import documents as D
from codexferry.functions import text as T
from codexferry.functions.urls import best_link
from codexferry.operators.html import parse_html

#: The object that closes a parsed text; see ``json_object``.
SEAL = "_end"
SOURCE_JSON = (
    "struct<metadata struct<originalSourceContentType:string, sourceAddedTimestamp:string, "
    f"youtubeMetadata:struct<videoId:string, channelName:string>>, {SEAL}:string>"
)
ARTIFACT_JSON = f"struct<artifactType:string, appType:string, title:string, {SEAL}:string>"
NOTEBOOK_JSON = "map<string,string>"
COPY_ORDER = ["root_path", "nb_file"]


# --- columns -----------------------------------------------------------------


def html_text(content: Column) -> Column:
    """Bytes as text; invalid UTF-8 becomes U+FFFD and a missing page is empty."""
    return F.coalesce(F.make_valid_utf8(content.cast("string")), F.lit(""))


def json_text(content: Column) -> Column:
    """Bytes as text, NULL unless they are valid UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` in the plan once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def json_object(text: Column, kind: str) -> Column:
    """The text as ``kind``, NULL unless all of it is one JSON object.

    Spark's JSON functions stop after the first value. So the text becomes the first item of a list
    whose second item names the text's own digest, which no text can hold: only if the parse comes
    to a list of just these two did nothing follow the object. One parse does both.
    """
    digest = F.md5(text.cast("binary"))
    sealed = F.concat(F.lit("["), text, F.lit(f',{{"{SEAL}":"'), digest, F.lit('"}]'))
    items = F.from_json(sealed, f"array<{kind}>", {"allowSingleQuotes": "false"})
    whole = lambda x: (F.size(x) == 2) & (F.get(x, F.lit(1))[SEAL] == digest)
    return once(items, lambda x: F.when(whole(x), F.get(x, F.lit(0))))


def skip_child_dirs(dir_name: Column) -> Column:
    return ~dir_name.isin(C.CHILD_DIRS)


def suffix_filter(file: Column, suffix: str) -> Column:
    """Metadata and HTML suffixes match exactly, ``.zip`` in any case."""
    return F.lower(file).endswith(".zip") if suffix == ".zip" else file.endswith(suffix)


def is_notebook(metadata: Column) -> Column:
    """The JSON object has a title or an emoji key, whatever its value."""
    return F.coalesce(once(json_object(metadata, NOTEBOOK_JSON), _has_book_key), F.lit(False))


def notebook_title(metadata: Column, file: Column) -> Column:
    return _title(once(json_object(metadata, NOTEBOOK_JSON), lambda x: _last(x, "title")), file)


def notebook_emoji(metadata: Column) -> Column:
    """The default applies only without the key; an explicit null stays null."""
    return once(json_object(metadata, NOTEBOOK_JSON), _emoji)


def _has_book_key(book: Column) -> Column:
    return F.arrays_overlap(F.map_keys(book), F.array(F.lit("title"), F.lit("emoji")))


def _last(entries: Column, key: str) -> Column:
    """Of a repeated key, the last value counts."""
    own = F.filter(F.map_entries(entries), lambda e: e["key"] == key)
    return F.try_element_at(own, F.lit(-1))["value"]


def _title(given: Column, file: Column) -> Column:
    return T.strip_space(
        T.first_nonempty(F.coalesce(given, F.lit("")), T.base_name(file), F.lit(C.UNTITLED_NOTEBOOK))
    )


def _emoji(book: Column) -> Column:
    present = F.array_contains(F.map_keys(book), "emoji")
    return F.when(present, _last(book, "emoji")).otherwise(C.DEFAULT_EMOJI)


def notebook_key(owner: Column, folder: Column) -> Column:
    return F.concat_ws("::", owner, F.lower(folder))


def sharepoint_folder(owner: Column, folder: Column) -> Column:
    return T.join_path(owner, folder)


def source_fields(metadata: Column) -> Column:
    """Type, time, video id and channel; what is not one JSON object gives the defaults."""

    def fields(x: Column) -> Column:
        inner = x["metadata"]
        video = inner["youtubeMetadata"]
        kind = F.coalesce(inner["originalSourceContentType"], F.lit(C.TYPE_UNKNOWN))
        return F.struct(
            kind.alias("source_type"),
            F.coalesce(inner["sourceAddedTimestamp"], F.lit("")).alias("added_timestamp"),
            F.coalesce(video["videoId"], F.lit("")).alias("video_id"),
            F.coalesce(video["channelName"], F.lit("")).alias("youtube_channel"),
        )

    return once(json_object(metadata, SOURCE_JSON), fields)


def youtube_url(video_id: Column) -> Column:
    return F.when(video_id != "", F.concat(F.lit(C.VIDEO_URL_PREFIX), video_id)).otherwise("")


def source_url(youtube: Column, source_type: Column, recovered: Column) -> Column:
    return (
        F.when(youtube != "", youtube)
        .when(source_type == C.TYPE_URL, F.coalesce(recovered, F.lit("")))
        .otherwise("")
    )


def artifact_fields(metadata: Column, base: Column) -> Column:
    """Title and type; what is not one JSON object gives the defaults."""

    def fields(x: Column) -> Column:
        kinds = T.nonempty(x["artifactType"]), T.nonempty(x["appType"])
        return F.struct(
            F.coalesce(T.nonempty(x["title"]), base).alias("title"),
            F.coalesce(*kinds, F.lit(C.DEFAULT_ARTIFACT_TYPE)).alias("artifact_type"),
        )

    return once(json_object(metadata, ARTIFACT_JSON), fields)


def staged_path(owner: Column, folder: Column, kind: str, base: Column) -> Column:
    """Path of a document below the staging root."""
    return T.join_path(
        owner, folder, F.lit(kind), F.concat(T.sanitize_filename(base), F.lit(".docx"))
    )


# --- discovery ---------------------------------------------------------------


def split_tree(tree: DataFrame) -> DataFrame:
    """Add ``dir``, ``dir_name`` and ``file`` to a tree."""
    whole = F.col("part").isNull() if "part" in tree.columns else F.lit(True)
    return (
        tree.where(F.col("entry_path").isNotNull() & F.col("content").isNotNull() & whole)
        .withColumn("dir", T.parent_dir(F.col("entry_path")))
        .withColumn("dir_name", T.file_name(F.col("dir")))
        .withColumn("file", T.file_name(F.col("entry_path")))
    )


KINDS = {"source": "Sources", "note": "Notes", "artifact": "Artifacts"}


def classify_tree(tree: DataFrame) -> DataFrame:
    """The files that matter with their ``kind``: notebook, source, note, artifact, error."""
    if "entry_error" not in tree.columns:
        tree = tree.withColumn("entry_error", F.lit(None).cast("string"))
    if "part" in tree.columns:
        cut = F.when(F.col("part") == 0, F.lit("an entry in parts does not fit into a value"))
        tree = tree.where("part is null or part = 0").withColumn("entry_error", F.coalesce("entry_error", cut))
    path = F.col("entry_path")
    dir_name, file = T.file_name(T.parent_dir(path)), T.file_name(path)
    kind = F.when(F.col("entry_error").isNotNull(), "error").when(
        skip_child_dirs(dir_name) & suffix_filter(file, C.METADATA_SUFFIX), "notebook"
    )
    for name, folder in KINDS.items():
        kind = kind.when(dir_name == folder, name)
    # What could not be read is listed, not kept.
    content = F.when(F.col("entry_error").isNull(), F.col("content")).alias("content")
    whole = F.col("content").isNotNull() | F.col("entry_error").isNotNull()
    return (
        tree.where(whole)
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select("archive", "entry_path", "entry_no", content, "entry_error", "kind")
    )


def _last_content(files: DataFrame, keys: list[str]) -> DataFrame:
    """Content of each path from its last archive.

    The shuffle comes first so that large contents are sorted once, not on both
    sides of it; keys are single paths, so no group is large.
    """
    return (
        files.repartition(*keys)
        .groupBy(*keys)
        .agg(F.max_by("content", F.struct("archive", "entry_no")).alias("content"))
    )


def discover_notebooks(tree: DataFrame, default_owner: str) -> DataFrame:
    """One row per notebook copy."""
    files = split_tree(tree).where(
        suffix_filter(F.col("file"), C.METADATA_SUFFIX) & skip_child_dirs(F.col("dir_name"))
    )
    metadata = _last_content(files, ["dir", "file"]).select(
        F.col("dir").alias("root_path"),
        F.col("file").alias("nb_file"),
        json_text(F.col("content")).alias("metadata"),
    )
    return notebook_rows(metadata, default_owner)


def notebook_rows(metadata: DataFrame, default_owner: Column | str) -> DataFrame:
    """The notebooks among ``root_path, nb_file, metadata`` with their derived columns.

    The parsed object is generated, so that it is there once for the test and all columns.
    """
    book = F.filter(F.array(json_object(F.col("metadata"), NOTEBOOK_JSON)), _has_book_key)
    return (
        metadata.select("*", F.explode(book).alias("_book"))
        .withColumn("owner_email", T.infer_owner_email(F.col("root_path"), default_owner))
        .withColumn("title", _title(_last(F.col("_book"), "title"), F.col("nb_file")))
        .withColumn("emoji", _emoji(F.col("_book")))
        .drop("_book")
        .withColumn("folder", T.sanitize_filename(F.col("title")))
        .withColumn("nb_key", notebook_key(F.col("owner_email"), F.col("folder")))
        .withColumn(
            "sharepoint_folder", sharepoint_folder(F.col("owner_email"), F.col("folder"))
        )
    )


def attach_html(files: DataFrame) -> DataFrame:
    """Source metadata with its page by folder and base name.

    Metadata drives: a page without metadata is dropped, metadata without a page
    has a NULL page. Both files of a source meet in one group of two rows, so the
    files are read and shuffled once instead of twice for a join.
    """
    is_meta = suffix_filter(F.col("file"), C.METADATA_SUFFIX)
    is_html = suffix_filter(F.col("file"), C.HTML_SUFFIX)
    order = F.struct("archive", "entry_no")
    return (
        files.where(is_meta | is_html)
        .withColumn("base", T.base_name(F.col("file")))
        .repartition("dir", "base")
        .groupBy("dir", "base")
        .agg(
            F.max(F.when(is_meta, True)).alias("has_metadata"),
            F.max_by("content", F.when(is_meta, order)).alias("metadata"),
            F.max_by("content", F.when(is_html, order)).alias("html"),
        )
        .where("has_metadata")
        .drop("has_metadata")
    )


def discover_sources(tree: DataFrame) -> DataFrame:
    """One row per source of a copy, with the page's text in ``html``."""
    pairs = attach_html(split_tree(tree).where(F.col("dir_name") == "Sources"))
    return pairs.select(
        T.parent_dir(F.col("dir")).alias("root_path"),
        F.concat("base", F.lit(C.METADATA_SUFFIX)).alias("file"),
        F.col("base").alias("title"),
        source_fields(json_text(F.col("metadata"))).alias("_fields"),
        html_text(F.col("html")).alias("html"),
    ).select("root_path", "file", "title", "_fields.*", "html")


def parse_sources(sources: DataFrame) -> DataFrame:
    """Parse pages once: adds blocks, addresses and word count, drops ``html``."""
    parsed = parse_html(sources).withColumn("youtube_url", youtube_url(F.col("video_id")))
    # Links are scored only where the result is used.
    wanted = (F.col("source_type") == C.TYPE_URL) & (F.col("youtube_url") == "")
    recovered = F.when(wanted, best_link(F.col("title"), F.col("hrefs"))["url"])
    return (
        parsed.withColumn(
            "source_url", source_url(F.col("youtube_url"), F.col("source_type"), recovered)
        )
        .withColumn("word_count", D.blocks_word_count(F.col("blocks")))
        .drop("hrefs", "video_id")
    )


def discover_notes(tree: DataFrame) -> DataFrame:
    """One row per note of a copy, with its text and blocks."""
    files = split_tree(tree).where(
        (F.col("dir_name") == "Notes") & suffix_filter(F.col("file"), C.HTML_SUFFIX)
    )
    pages = _last_content(files, ["dir", "file"]).select(
        T.parent_dir(F.col("dir")).alias("root_path"),
        "file",
        T.base_name(F.col("file")).alias("title"),
        html_text(F.col("content")).alias("html"),
    )
    return (
        parse_html(pages)
        .drop("hrefs")
        .withColumn("content_text", D.note_text(F.col("blocks")))
    )


def discover_artifacts(tree: DataFrame) -> DataFrame:
    files = split_tree(tree).where(
        (F.col("dir_name") == "Artifacts") & suffix_filter(F.col("file"), C.METADATA_SUFFIX)
    )
    return (
        _last_content(files, ["dir", "file"])
        .select(
            T.parent_dir(F.col("dir")).alias("root_path"),
            "file",
            artifact_fields(json_text(F.col("content")), T.base_name(F.col("file"))).alias("_a"),
        )
        .select("root_path", "file", "_a.*")
    )


# --- merging copies ----------------------------------------------------------


def merge_notebooks(copies: DataFrame) -> DataFrame:
    """The first copy of each notebook.

    Spark cuts each key to one row before the shuffle (window group limit), so a
    notebook with very many copies does not land in one task.
    """
    first = W.partitionBy("nb_key").orderBy(*COPY_ORDER)
    return copies.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def in_copies(children: DataFrame, copies: DataFrame) -> DataFrame:
    """Children with the key, owner and folder of every notebook in their root."""
    return children.join(
        copies.select("root_path", "nb_file", "nb_key", "owner_email", "folder"), "root_path"
    )


def merge_sources(
    sources: DataFrame, copies: DataFrame, notebooks: DataFrame | None = None
) -> DataFrame:
    """Sources per notebook: the first copy's, then unseen titles of later copies.

    A title comes from the first copy that has it. ``copy_path``, ``copy_file`` and
    ``file`` give the order; ``from_later_copy`` marks what was appended.
    ``notebooks`` are the merged notebooks if they exist already.
    """
    if notebooks is None:
        notebooks = merge_notebooks(copies)
    by_title = W.partitionBy("nb_key", "title").orderBy(*COPY_ORDER)
    kept = (
        sources.join(
            copies.select("root_path", "nb_file", "nb_key", F.col("folder").alias("_copy_folder")),
            "root_path",
        )
        .withColumn("_rank", F.row_number().over(by_title))
        .where("_rank = 1")
        .drop("_rank")
        .withColumnsRenamed({"root_path": "copy_path", "nb_file": "copy_file"})
    )
    first = notebooks.select(
        "nb_key",
        "owner_email",
        "folder",
        F.col("title").alias("notebook_title"),
        F.struct("root_path", "nb_file").alias("_first"),
    )
    return (
        kept.join(first, "nb_key")
        .withColumn(
            "from_later_copy",
            (F.col("copy_path") != F.col("_first.root_path"))
            | (F.col("copy_file") != F.col("_first.nb_file")),
        )
        .withColumn(
            "relative_sharepoint_path",
            # A document is staged below the folder of its own copy.
            staged_path(F.col("owner_email"), F.col("_copy_folder"), "Sources", F.col("title")),
        )
        .drop("_first", "_copy_folder")
    )


def merge_new_titles(sources: DataFrame, copies: DataFrame) -> DataFrame:
    """Only the sources that later copies add to a notebook."""
    return merge_sources(sources, copies).where("from_later_copy")


def first_copy_children(children: DataFrame, notebooks: DataFrame, kind: str) -> DataFrame:
    """Notes or artifacts of the first copies; those of later copies are dropped."""
    first = notebooks.select(
        "root_path", "nb_key", "owner_email", "folder", F.col("title").alias("notebook_title")
    )
    joined = children.join(first, "root_path")
    if kind == "Notes":
        joined = joined.withColumn(
            "relative_sharepoint_path",
            staged_path(F.col("owner_email"), F.col("folder"), "Notes", F.col("title")),
        )
    return joined.withColumnRenamed("root_path", "copy_path")


def path_collisions(staged: DataFrame) -> DataFrame:
    """Staged paths that more than one child of a notebook would take."""
    return (
        staged.groupBy("nb_key", "relative_sharepoint_path")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )

"""Column functions: text, links, labels, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexferry import constants as C
from codexferry.bindings import adapters as A
from codexferry.bindings import sqltext as Q
from codexferry.bindings.registry import query
from codexferry.functions import documents as D
from codexferry.functions import labels as L
from codexferry.functions import text as T
from codexferry.functions import urls as U
from codexferry.operators import notebooks as N
from codexferry.operators.html import parse_html

DOC_TITLE = "source || '/' || lang || ': ' || left(text, 240)"


def _doc_title():
    return F.concat("source", F.lit("/"), "lang", F.lit(": "), F.substring("text", 1, 240))


@query(
    "sanitize_filename",
    f"SELECT doc_id, {Q.sanitize('text')} AS from_text, {Q.sanitize(DOC_TITLE)} AS from_title FROM documents",
)
def sanitize_filename(spark, sf):
    return A.table(spark, sf, "documents").select(
        "doc_id",
        T.sanitize_filename(F.col("text")).alias("from_text"),
        T.sanitize_filename(_doc_title()).alias("from_title"),
    )


@query(
    "infer_owner_email",
    f"SELECT doc_id, {Q.owner_in('text', chr(39) + A.DEFAULT_OWNER + chr(39))} AS owner_email FROM documents",
)
def infer_owner_email(spark, sf):
    return A.table(spark, sf, "documents").select(
        "doc_id", T.infer_owner_email(F.col("text"), A.DEFAULT_OWNER).alias("owner_email")
    )


@query(
    "base_name",
    f"""WITH {Q.DOCS}
    SELECT doc_id, base AS from_metadata, base || '.html' AS from_both, 'Note ' || lang AS from_page FROM docs""",
)
def base_name(spark, sf):
    meta = F.lit(C.METADATA_SUFFIX)
    return A.docs(spark, sf).select(
        "doc_id",
        T.base_name(F.concat("base", meta)).alias("from_metadata"),
        T.base_name(F.concat("base", F.lit(".html"), meta)).alias("from_both"),
        T.base_name(F.concat(F.lit("Note "), "lang", F.lit(".html"))).alias("from_page"),
    )


@query("xml_text", f"SELECT doc_id, {Q.xml('text')} AS xml FROM documents")
def xml_text(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", T.xml_text(F.col("text")).alias("xml"))


@query(
    "word_count",
    f"SELECT doc_id, {Q.words('text')} + {Q.words('source')} AS word_count FROM documents",
)
def word_count(spark, sf):
    blocks = F.array(
        *[
            F.struct(F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"),
                     F.col(c).alias("text"))
            for c in ("text", "source")
        ]
    )
    return A.table(spark, sf, "documents").select(
        "doc_id", D.blocks_word_count(blocks).alias("word_count")
    )


LINES = (
    "list_filter(list_transform(regexp_split_to_array(text, "
    r"'\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]'), "
    f"lambda x: {Q.strip('x')}), lambda x: x <> '')"
)


@query(
    "page_text_fallback",
    f"""SELECT doc_id, len({LINES})::BIGINT AS n_blocks, array_to_string({LINES}, '|') AS lines FROM documents""",
)
def page_text_fallback(spark, sf):
    """Pages without a block: each line of their text is a paragraph."""
    pages = A.table(spark, sf, "documents").select(
        "doc_id", A.blockless_html(F.col("text")).alias("html")
    )
    return parse_html(pages).select(
        "doc_id",
        F.size("blocks").cast("long").alias("n_blocks"),
        F.array_join(F.transform("blocks", lambda b: b["text"]), "|").alias("lines"),
    )


@query(
    "note_text",
    f"SELECT doc_id, coalesce(array_to_string({LINES}, chr(10) || chr(10)), '') AS content_text FROM documents",
)
def note_text(spark, sf):
    return A.table(spark, sf, "documents").select(
        "doc_id", D.note_text(A.text_line_blocks(F.col("text"))).alias("content_text")
    )


@query(
    "nonempty_blocks",
    f"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\n'), lambda x: {Q.strip('x')} <> ''))::BIGINT AS n_blocks
    FROM documents""",
)
def nonempty_blocks(spark, sf):
    """Paragraphs without text are no blocks."""
    pages = A.table(spark, sf, "documents").select(
        "doc_id", A.paragraph_html(F.col("text")).alias("html")
    )
    return parse_html(pages).select("doc_id", F.size("blocks").cast("long").alias("n_blocks"))


# A document as header lines, a heading of each level, bullets and paragraphs.
STYLED = f"""styled AS (
  SELECT doc_id, no, CASE kind WHEN 0 THEN 'h' WHEN 1 THEN 'b' ELSE 'p' END AS kind, level, line FROM (
    SELECT doc_id, no, no % 3 AS kind, CASE WHEN no % 3 = 0 THEN (no // 3) % 4 + 1 END AS level, list[no + 1] AS line
    FROM (SELECT doc_id, {LINES} AS list FROM documents), LATERAL (SELECT unnest(range(len(list))) AS no))),
paragraphs AS (
  SELECT doc_id, no + 10 AS no,
         CASE WHEN kind = 'b' THEN '• ' || line ELSE line END AS text,
         CASE WHEN kind <> 'h' THEN 22 WHEN level = 1 THEN 32 WHEN level = 2 THEN 28 ELSE 24 END AS size,
         CASE WHEN kind = 'h' THEN '174EA6' ELSE '202124' END AS color, kind = 'h' AS bold
  FROM styled
  UNION ALL SELECT doc_id, 0, source || ' & ' || lang, 36, '1A73E8', true FROM documents
  UNION ALL SELECT doc_id, 1, 'Original Source Type: ' || lang || ' | Owner: ' || source || ' | Added: '
    || CASE WHEN lang = 'es' THEN 'N/A' ELSE doc_id::VARCHAR END, 18, '5F6368', false FROM documents
  UNION ALL SELECT doc_id, 2, 'Original Source URL: http://' || source, 20, '1A73E8', true FROM documents WHERE lang = 'en'
  UNION ALL SELECT doc_id, 3, 'YouTube Channel: ' || source, 18, '5F6368', false FROM documents WHERE lang = 'fr')"""


def _styled(spark, sf):
    lines = F.transform(A.text_line_blocks(F.col("text")), lambda b: b["text"])

    def block(line, no):
        kind = no % 3
        return F.struct(
            F.when(kind == 0, "heading").when(kind == 1, "bullet").otherwise("paragraph").alias("type"),
            F.when(kind == 0, (F.floor(no / 3) % 4 + 1).cast("int")).alias("level"),
            line.alias("text"),
        )

    none = F.lit("")
    return A.table(spark, sf, "documents").select(
        "doc_id",
        D.paragraph_styles(
            F.concat("source", F.lit(" & "), "lang"),
            F.col("lang"),
            F.col("source"),
            F.when(F.col("lang") != "es", F.col("doc_id").cast("string")),
            F.when(F.col("lang") == "en", F.concat(F.lit("http://"), "source")).otherwise(none),
            F.when(F.col("lang") == "fr", F.col("source")).otherwise(none),
            F.transform(lines, block),
        ).alias("paragraphs"),
    )


@query(
    "paragraph_style",
    f"""WITH {STYLED}
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1)::INTEGER AS seq,
           text, size, color, bold FROM paragraphs""",
)
def paragraph_style(spark, sf):
    return _styled(spark, sf).select(
        "doc_id", F.posexplode("paragraphs").alias("seq", "p")
    ).select("doc_id", "seq", "p.*")


def _xml_sql() -> str:
    para = (
        """'<w:p><w:r><w:rPr><w:sz w:val="' || size::VARCHAR || '"/><w:color w:val="' || color || '"/>'"""
        f""" || CASE WHEN bold THEN '<w:b/>' ELSE '' END || '</w:rPr><w:t xml:space="preserve">' || {Q.xml('text')}"""
        """ || '</w:t></w:r></w:p>'"""
    )
    return (
        f"""WITH {STYLED}, joined AS (
        SELECT doc_id, '{C.DOCX_BODY_OPEN}' || string_agg({para}, '' ORDER BY no) || '{C.DOCX_BODY_CLOSE}' AS xml
        FROM paragraphs GROUP BY doc_id)"""
    )


@query(
    "document_xml",
    f"{_xml_sql()} SELECT doc_id, length(xml)::BIGINT AS n_chars, md5(xml) AS xml_md5 FROM joined",
)
def document_xml(spark, sf):
    xml = D.document_xml(F.col("paragraphs"))
    return (
        _styled(spark, sf)
        .select("doc_id", xml.alias("xml"))
        .select("doc_id", F.length("xml").cast("long").alias("n_chars"), F.md5("xml").alias("xml_md5"))
    )


@query(
    "render_docx",
    f"""{_xml_sql()}
    SELECT doc_id, '[Content_Types].xml' AS part, md5('{C.DOCX_CONTENT_TYPES}') AS part_md5 FROM joined
    UNION ALL SELECT doc_id, '_rels/.rels', md5('{C.DOCX_RELS}') FROM joined
    UNION ALL SELECT doc_id, 'word/document.xml', md5(xml) FROM joined""",
)
def render_docx(spark, sf):
    """Documents packed and read back part by part."""
    from codexferry.operators.docx import render_docx as render
    from codexferry.sources.archives import unzip

    xml = D.document_xml(F.col("paragraphs")).alias("document_xml")
    packed = render(_styled(spark, sf).select(F.col("doc_id").cast("string").alias("archive"), xml))
    return unzip(packed.withColumn("dest", F.lit("")), A.DEFAULT_OWNER).select(
        F.col("archive").cast("long").alias("doc_id"),
        F.col("entry_path").alias("part"),
        F.md5("content").alias("part_md5"),
    )


@query(
    "source_type_label",
    f"""WITH {Q.DOCS}
    SELECT doc_id, CASE kind WHEN 'URL' THEN '🌐 Website URL' WHEN 'YOUTUBE_VIDEO' THEN '▶️ YouTube Video'
      WHEN 'PDF' THEN '📕 PDF Document' ELSE '📊 PowerPoint' END AS known,
      '📄 ' || source || 'SOURCE_CONTENT_TYPE_' || lang AS other FROM docs""",
)
def source_type_label(spark, sf):
    prefix = F.lit("SOURCE_CONTENT_TYPE_")
    other = F.concat("source", prefix, prefix, "lang")
    return A.docs(spark, sf).select(
        "doc_id",
        L.source_type_label(F.concat(prefix, "kind")).alias("known"),
        L.source_type_label(other).alias("other"),
    )


@query(
    "artifact_label",
    """SELECT doc_id, source || ' (' || upper(lang) || ')' AS artifact,
    source || ' (' || lang || 'ARTIFACT_TYPE_)' AS repeated, source || ' (' || lang || ')' AS app FROM documents""",
)
def artifact_label(spark, sf):
    title = F.col("source")
    artifact = F.lit("ARTIFACT_TYPE_")
    return A.table(spark, sf, "documents").select(
        "doc_id",
        L.artifact_label(title, F.concat(artifact, F.upper("lang"))).alias("artifact"),
        L.artifact_label(title, F.concat(artifact, "lang", artifact)).alias("repeated"),
        L.artifact_label(title, F.concat(F.lit("APP_TYPE_"), "lang")).alias("app"),
    )


@query(
    "origin_cell",
    """SELECT page_id, CASE WHEN url LIKE 'https%' THEN '[' || url || '](' || url || ')' ELSE '_Uploaded File_' END AS cell,
    CASE WHEN url LIKE 'https%' THEN '🔗 ' || url || CASE WHEN page_id % 2 = 0 THEN ' 📺 ch' ELSE '' END
         ELSE '📁 Uploaded File Snapshot (Converted to .docx)' END AS label FROM pages""",
)
def origin_cell(spark, sf):
    url = F.when(F.col("url").startswith("https"), F.col("url")).otherwise("")
    channel = F.when(F.col("page_id") % 2 == 0, "ch").otherwise("")
    return A.table(spark, sf, "pages").select(
        "page_id", L.origin_cell(url).alias("cell"), L.origin_label(url, channel).alias("label")
    )


# --- links -------------------------------------------------------------------


def _links(spark, sf):
    """Absolute links of the pages with parts, hints, score and test, one per row."""

    pages = parse_html(A.linked_pages(spark, sf))
    links = pages.select(
        "page_id", "title", F.posexplode(U.absolute_links(F.col("hrefs"))).alias("position", "url")
    )
    parts = U.url_parts(F.col("url"))
    return links.withColumn("parts", parts).where(U.url_is_valid(F.col("parts")))


@query(
    "html_links",
    f"""WITH {Q.PAGES} SELECT page_id, idx::INTEGER AS idx, href FROM hrefs""",
)
def html_links(spark, sf):

    return parse_html(A.linked_pages(spark, sf)).select(
        "page_id", F.posexplode("hrefs").alias("idx", "href")
    )


@query(
    "link_is_absolute",
    f"""WITH {Q.LINKS}, raw AS (
      SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages
      UNION ALL SELECT page_id, href FROM hrefs)
    SELECT page_id, count(*) AS n_links,
           count(*) FILTER (WHERE href LIKE 'http://%' OR href LIKE 'https://%') AS n_absolute
    FROM raw GROUP BY page_id""",
)
def link_is_absolute(spark, sf):

    both = A.table(spark, sf, "pages").select("page_id", "html").unionByName(
        A.linked_pages(spark, sf).select("page_id", "html")
    )
    links = parse_html(both).select("page_id", F.explode("hrefs").alias("href"))
    return links.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_links"),
        F.count_if(U.link_is_absolute(F.col("href"))).alias("n_absolute"),
    )


@query(
    "canonicalize_url",
    f"""WITH {Q.LINKS} SELECT page_id, position::INTEGER AS position, url, canonical FROM scored""",
)
def canonicalize_url(spark, sf):
    return _links(spark, sf).select(
        "page_id", "position", "url", U.canonical_from_parts(F.col("parts")).alias("canonical")
    )


# Variants of each page's address, so that every blocking rule meets data.
VARIANTS = {
    "plain": "url",
    "cart": "url || '/cart/x'",
    "edit": "split_part(url, '#', 1) || '?action=edit'",
    "special": "replace(url, 'example', 'example.org/wiki/Special:')",
    "host": "replace(url, '.example', '-microsoft.com')",
}


def _variant_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT page_id, '{name}' AS variant, {sql} AS url FROM pages" for name, sql in VARIANTS.items()
    )
    return f"""variants AS ({rows}),
    tested AS (SELECT *, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS host,
      regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)), ';[^/]*$', '') AS path,
      regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query FROM variants)"""


@query(
    "link_not_blocked",
    f"""WITH {_variant_sql()}
    SELECT page_id, variant, NOT (
      len(list_filter([{Q.quoted(C.BLOCKED_HOSTS)}], lambda b: contains(host, b))) > 0
      OR len(list_filter([{Q.quoted(C.BLOCKED_PATHS)}], lambda b: contains(path, b))) > 0
      OR contains(query, 'action=edit') OR contains(query, 'printable=yes')) AS substring_rule,
      NOT (host = 't.co' OR host LIKE '%.t.co' OR regexp_matches(path, '/cart(/|$)')
      OR contains(path, '/special:') OR contains(query, 'action=edit')) AS exact_rule
    FROM tested""",
)
def link_not_blocked(spark, sf):
    pages = A.table(spark, sf, "pages")
    rows = pages.select(
        "page_id",
        F.explode(
            F.array(
                *[F.struct(F.lit(n).alias("variant"), F.expr(c).alias("url"))
                  for n, c in VARIANTS.items()]
            )
        ).alias("v"),
    ).select("page_id", "v.*")
    parts = rows.withColumn("parts", U.url_parts(F.col("url")))
    return parts.select(
        "page_id",
        "variant",
        U.link_not_blocked(F.col("parts")).alias("substring_rule"),
        U.link_not_blocked(F.col("parts"), "exact").alias("exact_rule"),
    )


@query(
    "link_score",
    f"""WITH {Q.LINKS}
    SELECT page_id, position::INTEGER AS position, url, score, allowed FROM scored""",
)
def link_score(spark, sf):
    rows = _links(spark, sf).withColumn("hints", U.title_hints(F.col("title")))
    return rows.select(
        "page_id",
        "position",
        "url",
        U.link_score(F.col("parts"), F.col("position"), F.col("hints")).alias("score"),
        U.link_not_blocked(F.col("parts")).alias("allowed"),
    )


# The same scoring against titles that resemble the address, so that every rule counts.
TITLED = Q.LINKS.replace(
    "regexp_extract(html, '<title>([^<]*)</title>', 1) AS title",
    "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[^a-zA-Z0-9]+', ' ', 'g') || ' - ' "
    "|| regexp_extract(url, '^[a-z]+://[a-z]+[.]([a-z-]+)', 1) AS title",
)


@query(
    "best_link",
    f"""WITH {TITLED} SELECT p.page_id, b.source_url, b.score, b.position::INTEGER AS position
    FROM linked_pages p LEFT JOIN best b USING (page_id)""",
)
def best_link(spark, sf):

    words = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[^a-zA-Z0-9]+", " ")
    site = F.regexp_extract("url", "^[a-z]+://[a-z]+[.]([a-z-]+)", 1)
    pages = parse_html(A.linked_pages(spark, sf)).withColumn(
        "title", F.concat(words, F.lit(" - "), site)
    )
    best = U.best_link(F.col("title"), F.col("hrefs")).alias("best")
    return pages.select("page_id", best).select(
        "page_id",
        F.col("best.url").alias("source_url"),
        F.col("best.score").alias("score"),
        F.col("best.position").alias("position"),
    )


@query(
    "recover_source_url",
    f"""WITH {Q.LINKS} SELECT p.page_id, coalesce(b.source_url, '') AS source_url
    FROM linked_pages p LEFT JOIN best b USING (page_id)""",
)
def recover_source_url(spark, sf):

    pages = parse_html(A.linked_pages(spark, sf))
    best = U.best_link(F.col("title"), F.col("hrefs"))["url"]
    return pages.select("page_id", F.coalesce(best, F.lit("")).alias("source_url"))


# h1 and li are well-formed in every page, so a pattern finds their text.
# The last character reference of a piece may lack its semicolon.
UNESCAPED = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&lt(;|$)', '<', 'g'), "
    "'&gt(;|$)', '>', 'g'), '&quot(;|$)', chr(34), 'g'), '&amp(;|$)', '&', 'g')"
)


@query(
    "html_blocks",
    r"""WITH found AS (
      SELECT page_id, unnest(regexp_extract_all(html, '<(?:h1|li)>.*?</(?:h1|li)>')) AS element FROM pages),
    texts AS (
      SELECT page_id, CASE WHEN element LIKE '<h1>%' THEN 'heading' ELSE 'bullet' END AS type,
             trim({text}) AS text
      FROM found)
    SELECT page_id, type, count(*) AS n_blocks, string_agg(text, '|' ORDER BY text) AS texts
    FROM texts WHERE text <> '' GROUP BY page_id, type""".format(
        text=UNESCAPED.format("regexp_replace(element, '<[^>]*>', '', 'g')")
    ),
)
def html_blocks(spark, sf):
    """Headings and bullets of whole pages, texts in order of text."""

    pages = parse_html(A.table(spark, sf, "pages").select("page_id", "html"))
    blocks = F.filter("blocks", lambda b: b["type"].isin("heading", "bullet"))
    kinds = F.array(F.lit("heading"), F.lit("bullet"))
    return (
        pages.select("page_id", blocks.alias("blocks"), F.explode(kinds).alias("type"))
        .withColumn(
            "texts",
            F.transform(
                F.filter("blocks", lambda b: b["type"] == F.col("type")), lambda b: b["text"]
            ),
        )
        .where(F.size("texts") > 0)
        .select(
            "page_id",
            "type",
            F.size("texts").cast("long").alias("n_blocks"),
            F.array_join(F.array_sort("texts"), "|").alias("texts"),
        )
    )


# In the pages a paragraph that opens with <b> is never closed and holds the rest of
# the article; every other paragraph ends at its own end tag.
PIECES = f"""list_filter(list_transform(string_split(regexp_replace(x, '<[^>]*>', chr(1), 'g'), chr(1)),
  lambda y: {Q.strip(UNESCAPED.format("y"))}),
  lambda y: y <> '')"""


@query(
    "html_paragraphs",
    f"""WITH split AS (
      SELECT page_id, regexp_extract_all(html, '(?s)<li>.*?</li>') AS items, regexp_extract(html, '(?s)<h1>.*?</h1>') AS h1,
        string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>') AS segments FROM pages),
    elements AS (
      SELECT page_id, items || [h1] || list_transform(range(2, len(segments) + 1), lambda i:
        CASE WHEN starts_with(segments[i], '<b>') THEN array_to_string(segments[i:], '<p>')
             ELSE string_split(segments[i], '</p>')[1] END) AS elements FROM split),
    texts AS (
      SELECT page_id, list_filter(list_transform(elements, lambda x: array_to_string({PIECES}, ' ')), lambda t: t <> '') AS texts
      FROM elements)
    SELECT page_id, len(texts)::BIGINT AS n_blocks,
      list_sum(list_transform(texts, lambda t: len(regexp_extract_all(t, '[^{Q.SPACE}]+'))))::BIGINT AS word_count,
      md5(array_to_string(texts, chr(10) || chr(10))) AS text_md5 FROM texts""",
)
def html_paragraphs(spark, sf):
    """All blocks of whole pages, unclosed paragraphs included."""

    return parse_html(A.table(spark, sf, "pages").select("page_id", "html")).select(
        "page_id",
        F.size("blocks").cast("long").alias("n_blocks"),
        D.blocks_word_count(F.col("blocks")).alias("word_count"),
        F.md5(D.note_text(F.col("blocks"))).alias("text_md5"),
    )


# --- files and JSON ------------------------------------------------------------


@query(
    "read_html_text",
    "SELECT doc_id, text AS valid, '' AS missing, text || '�' AS repaired FROM documents",
)
def read_html_text(spark, sf):
    raw = F.encode("text", "UTF-8")
    return A.table(spark, sf, "documents").select(
        "doc_id",
        N.html_text(raw).alias("valid"),
        N.html_text(F.lit(None).cast("binary")).alias("missing"),
        N.html_text(F.concat(raw, F.unhex(F.lit("FF")))).alias("repaired"),
    )


@query(
    "is_notebook",
    """SELECT doc_id, true AS with_title, true AS null_emoji, false AS neither, false AS corrupt, false AS other_type,
    false AS with_tail
    FROM documents""",
)
def is_notebook(spark, sf):
    title = F.to_json(F.struct(F.col("text").alias("title"), F.col("lang").alias("x")))
    emoji = F.concat(F.lit('{"x": 1, "emoji": null, "lang": "'), "lang", F.lit('"}'))
    other = F.to_json(F.struct(F.col("text").alias("titles")))
    return A.table(spark, sf, "documents").select(
        "doc_id",
        N.is_notebook(title).alias("with_title"),
        N.is_notebook(emoji).alias("null_emoji"),
        N.is_notebook(other).alias("neither"),
        N.is_notebook(F.substring(title, 1, 12)).alias("corrupt"),
        N.is_notebook(F.concat(F.lit("["), title, F.lit("]"))).alias("other_type"),
        N.is_notebook(F.concat(title, F.lit(" x"))).alias("with_tail"),
    )


@query(
    "notebook_title",
    f"""WITH {Q.DOCS} SELECT doc_id, CASE WHEN text = '' THEN book_dir ELSE {Q.strip('text')} END AS given,
      book_dir AS from_file, 'Untitled Notebook' AS untitled FROM docs""",
)
def notebook_title(spark, sf):
    meta = F.lit(C.METADATA_SUFFIX)
    file = F.concat("book_dir", meta)
    empty = F.lit('{"title": ""}')
    return A.docs(spark, sf).select(
        "doc_id",
        N.notebook_title(F.to_json(F.struct(F.col("text").alias("title"))), file).alias("given"),
        N.notebook_title(empty, file).alias("from_file"),
        N.notebook_title(empty, meta).alias("untitled"),
    )


@query(
    "notebook_keys",
    f"""WITH {Q.DOCS} SELECT doc_id, owner || '::' || lower({Q.sanitize('text')}) AS nb_key,
    owner || '/' || {Q.sanitize('text')} AS sharepoint_folder FROM docs""",
)
def notebook_keys(spark, sf):
    folder = T.sanitize_filename(F.col("text"))
    return A.docs(spark, sf).select(
        "doc_id",
        N.notebook_key(F.col("owner"), folder).alias("nb_key"),
        N.sharepoint_folder(F.col("owner"), folder).alias("sharepoint_folder"),
    )


@query(
    "source_fields",
    f"""WITH {Q.SOURCES} SELECT doc_id, source_type, added_timestamp, video_id, youtube_channel FROM raw_sources""",
)
def source_fields(spark, sf):
    return (
        A.docs(spark, sf)
        .select("doc_id", N.source_fields(A.source_json()).alias("f"))
        .select("doc_id", "f.*")
    )


@query(
    "youtube_url",
    f"""WITH {Q.SOURCES} SELECT doc_id, youtube_url FROM all_sources""",
)
def youtube_url(spark, sf):
    fields = A.docs(spark, sf).select("doc_id", N.source_fields(A.source_json()).alias("f"))
    return fields.select("doc_id", N.youtube_url(F.col("f.video_id")).alias("youtube_url"))


@query(
    "source_url",
    f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '{C.VIDEO_URL_PREFIX}' || page_id::VARCHAR ELSE '' END AS youtube_url,
    CASE WHEN page_id % 3 = 0 THEN '{C.VIDEO_URL_PREFIX}' || page_id::VARCHAR
         WHEN page_id % 3 = 1 THEN url ELSE '' END AS source_url FROM pages""",
)
def source_url(spark, sf):
    page = F.col("page_id")
    video = F.when(page % 3 == 0, page.cast("string")).otherwise("")
    kind = F.when(page % 3 == 1, C.TYPE_URL).otherwise("SOURCE_CONTENT_TYPE_PDF")
    return A.table(spark, sf, "pages").select(
        "page_id",
        N.youtube_url(video).alias("youtube_url"),
        N.source_url(N.youtube_url(video), kind, F.col("url")).alias("source_url"),
    )


@query(
    "staged_paths",
    f"""WITH {Q.DOCS} SELECT doc_id, owner || '/' || {Q.sanitize('book_title')} || '/Sources/' || {Q.sanitize('text')} || '.docx'
    AS relative_sharepoint_path,
    '/stage/' || owner || '/' || {Q.sanitize('book_title')} || '/Notes/' || base || '.docx' AS docx_path FROM docs""",
)
def staged_paths(spark, sf):
    folder = T.sanitize_filename(F.col("book_title"))
    owner = F.col("owner")
    return A.docs(spark, sf).select(
        "doc_id",
        N.staged_path(owner, folder, "Sources", F.col("text")).alias("relative_sharepoint_path"),
        T.join_path(F.lit("/stage"), N.staged_path(owner, folder, "Notes", F.col("base"))).alias(
            "docx_path"
        ),
    )


@query(
    "artifact_fields",
    f"""WITH {Q.CHILDREN} SELECT root_path, file, title, artifact_type FROM raw_artifacts""",
)
def artifact_fields(spark, sf):
    d = A.docs(spark, sf).where("lang in ('fr', 'es')")
    base = F.concat(F.lit("Art "), F.col("doc_id").cast("string"))
    return d.select(
        "root_path",
        F.concat(base, F.lit(C.METADATA_SUFFIX)).alias("file"),
        N.artifact_fields(A.artifact_json(), base).alias("a"),
    ).select("root_path", "file", "a.*")


FILE_NAMES = """files AS (
  SELECT doc_id, unnest([base || ' metadata.json', base || '.html', base || '.HTML', base || '.ZIP', base || '.zip',
    base || '.metadata.json']) AS file FROM docs)"""


def _file_names(spark, sf):
    base = F.col("base")
    ends = [" metadata.json", ".html", ".HTML", ".ZIP", ".zip", ".metadata.json"]
    return A.docs(spark, sf).select(
        "doc_id", "base", F.explode(F.array(*[F.concat(base, F.lit(e)) for e in ends])).alias("file")
    )


@query(
    "suffix_filter",
    f"""WITH {Q.DOCS}, {FILE_NAMES} SELECT doc_id, file, suffix(file, ' metadata.json') AS is_metadata,
    suffix(file, '.html') AS is_html, suffix(lower(file), '.zip') AS is_zip FROM files""",
)
def suffix_filter(spark, sf):
    file = F.col("file")
    return _file_names(spark, sf).select(
        "doc_id",
        "file",
        N.suffix_filter(file, C.METADATA_SUFFIX).alias("is_metadata"),
        N.suffix_filter(file, C.HTML_SUFFIX).alias("is_html"),
        N.suffix_filter(file, ".zip").alias("is_zip"),
    )

"""Pieces of SQL for the twins: text rules and the adapters as common tables."""

from __future__ import annotations

from codexferry import constants as C

SPACE = (
    r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"


def sanitize(x: str) -> str:
    safe = strip(rf"""regexp_replace({x}, '[<>:"/\\|?*\x00-\x1f]', '_', 'g')""")
    one = f"regexp_replace({safe}, '[{SPACE}]+', ' ', 'g')"
    return f"coalesce(nullif(left(regexp_replace({one}, '[. ]+$', ''), 180), ''), 'Untitled')"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{SPACE}]+'))::BIGINT"


def owner_in(x: str, default: str) -> str:
    return f"coalesce(nullif(lower(regexp_extract({x}, '{C.EMAIL_PATTERN}', 1)), ''), {default})"


def user(x: str) -> str:
    """user001 and so on."""
    return f"'user' || lpad(({x})::VARCHAR, greatest(3, length(({x})::VARCHAR))::INTEGER, '0')"


def xml(x: str) -> str:
    clean = rf"regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')"
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                         ("''", "&#x27;")]:
        clean = f"replace({clean}, '{char}', '{entity}')"
    return clean


SITE = f"'{C.SITE_URL_PREFIX}'"

# documents as an export: 40 documents are an owner, 20 a copy, 4 a notebook of a copy.
DOCS = rf"""docs AS (
  SELECT doc_id, text, lang, source,
         {user('doc_id // 40')} || '@old.example' AS owner,
         (doc_id // 20) % 2 AS copy,
         (doc_id % 20) // 4 AS book,
         'Book ' || ((doc_id % 20) // 4)::VARCHAR AS book_dir,
         CASE WHEN (doc_id // 20) % 2 = 1 THEN 'BOOK ' ELSE 'Book ' END
           || ((doc_id % 20) // 4)::VARCHAR || ': é' AS book_title,
         lang || (doc_id % 4)::VARCHAR AS base,
         CASE lang WHEN 'en' THEN 'URL' WHEN 'fr' THEN 'YOUTUBE_VIDEO'
                   WHEN 'de' THEN 'PDF' ELSE 'POWERPOINT' END AS kind,
         doc_id % 17 = 3 AS broken,
         doc_id % 23 = 5 AS pageless
  FROM documents),
rooted AS (
  SELECT *, 'export' || copy::VARCHAR || '/' || owner || '/Export/' || book_dir AS root_path
  FROM docs)"""

# Notebook copies and merged notebooks.
BOOKS = rf"""{DOCS},
copies AS (
  SELECT DISTINCT root_path, book_dir || ' metadata.json' AS nb_file, owner AS owner_email,
         book_title AS title, copy, {sanitize('book_title')} AS folder,
         owner || '::' || lower({sanitize('book_title')}) AS nb_key
  FROM rooted),
books AS (
  SELECT *, owner_email || '/' || folder AS sharepoint_folder FROM (
    SELECT *, row_number() OVER (PARTITION BY nb_key ORDER BY root_path, nb_file) AS rk FROM copies)
  WHERE rk = 1)"""

# Sources of every copy, then merged by title.
SOURCES = rf"""{BOOKS},
raw_sources AS (
  SELECT doc_id, root_path, base AS title, base || ' metadata.json' AS file, lang, source, text, copy,
         CASE WHEN broken THEN '{C.TYPE_UNKNOWN}' ELSE 'SOURCE_CONTENT_TYPE_' || kind END AS source_type,
         CASE WHEN broken THEN '' ELSE 'T' || doc_id::VARCHAR END AS added_timestamp,
         CASE WHEN broken OR lang <> 'fr' THEN '' ELSE 'v' || doc_id::VARCHAR END AS video_id,
         CASE WHEN broken OR lang <> 'fr' THEN '' ELSE source END AS youtube_channel,
         pageless,
         CASE WHEN pageless THEN 0 ELSE {words('base')} + {words('text')} END AS word_count
  FROM rooted),
linked AS (
  SELECT *, CASE WHEN video_id <> '' THEN '{C.VIDEO_URL_PREFIX}' || video_id ELSE '' END AS youtube_url
  FROM raw_sources),
all_sources AS (
  SELECT *, CASE WHEN youtube_url <> '' THEN youtube_url
                 WHEN source_type = '{C.TYPE_URL}' AND NOT pageless
                   THEN 'https://' || source || '.example/' || lang || '/' || doc_id::VARCHAR
                 ELSE '' END AS source_url
  FROM linked),
in_copies AS (
  SELECT s.*, c.nb_key, c.owner_email, c.folder, c.nb_file
  FROM all_sources s JOIN copies c USING (root_path)),
by_title AS (
  SELECT *, row_number() OVER (PARTITION BY nb_key, title ORDER BY root_path, nb_file) AS rk
  FROM in_copies),
sources AS (
  SELECT s.nb_key, s.title, s.source_type, s.added_timestamp, s.source_url, s.youtube_url,
         s.youtube_channel, s.word_count, s.root_path AS copy_path, s.file,
         b.owner_email, b.folder, b.title AS notebook_title,
         s.root_path <> b.root_path AS from_later_copy,
         s.owner_email || '/' || s.folder || '/Sources/' || {sanitize('s.title')} || '.docx'
           AS relative_sharepoint_path,
         row_number() OVER (PARTITION BY s.nb_key ORDER BY s.root_path, s.nb_file, s.file) AS position
  FROM by_title s JOIN books b USING (nb_key) WHERE s.rk = 1)"""

# Notes (German documents) and artifacts (French and Spanish ones) of the first copies.
CHILDREN = rf"""{SOURCES},
raw_notes AS (
  SELECT root_path, 'Note ' || doc_id::VARCHAR AS title, 'Note ' || doc_id::VARCHAR || '.html' AS file,
         CASE WHEN {strip('text')} = '' THEN lang ELSE {strip('text')} || chr(10) || chr(10) || lang END
           AS content_text
  FROM rooted WHERE lang = 'de'),
notes AS (
  SELECT b.nb_key, n.title, n.content_text, b.owner_email, b.title AS notebook_title, n.file,
         b.owner_email || '/' || b.folder || '/Notes/' || n.title || '.docx' AS relative_sharepoint_path,
         row_number() OVER (PARTITION BY b.nb_key ORDER BY n.root_path, n.file) AS position
  FROM raw_notes n JOIN books b USING (root_path)),
raw_artifacts AS (
  SELECT root_path, 'Art ' || doc_id::VARCHAR || ' metadata.json' AS file,
         CASE WHEN lang = 'fr' THEN source ELSE 'Art ' || doc_id::VARCHAR END AS title,
         CASE WHEN lang = 'fr' THEN 'APP_TYPE_FR'
              WHEN broken THEN '{C.DEFAULT_ARTIFACT_TYPE}' ELSE 'ARTIFACT_TYPE_ES' END AS artifact_type
  FROM rooted WHERE lang IN ('fr', 'es')),
artifacts AS (
  SELECT b.nb_key, a.title, a.artifact_type, a.file,
         row_number() OVER (PARTITION BY b.nb_key ORDER BY a.root_path, a.file) AS position
  FROM raw_artifacts a JOIN books b USING (root_path))"""

# customer as identity rows: some without an owner, a target or a site; written twice.
RAW_IDENTITY = rf"""raw_identity AS (
  SELECT c_custkey AS line_no,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN ' ' ELSE ' User' || substr({user('c_custkey')}, 5) || '@OLD.example ' END AS email,
         CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE {user('c_custkey')} || '@new.example' END AS upn,
         CASE WHEN c_mktsegment = 'FURNITURE' THEN ' ' || {user('c_custkey')} || '@cloud.example' ELSE NULL END AS ge,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'https://site.example/' || c_custkey::VARCHAR ELSE '' END AS site
  FROM customer
  UNION ALL
  SELECT c_custkey + (SELECT max(c_custkey) + 1 FROM customer),
         {user('c_custkey')} || '@old.example', {user('c_custkey')} || '@late.example', NULL, NULL
  FROM customer WHERE c_nationkey = 7 AND c_mktsegment <> 'MACHINERY')"""

IDENTITY = rf"""{RAW_IDENTITY},
identity0 AS (
  SELECT line_no, lower(nullif(trim(email), '')) AS gws_email, nullif(trim(upn), '') AS upn,
         nullif(trim(ge), '') AS ge, nullif(trim(site), '') AS site
  FROM raw_identity),
normalized AS (
  SELECT line_no, gws_email, coalesce(upn, gws_email) AS m365_upn,
         coalesce(ge, upn, gws_email) AS ge_target_email,
         coalesce(site, {SITE} || coalesce(upn, gws_email)) AS sharepoint_site_url
  FROM identity0),
identity AS (
  SELECT gws_email, m365_upn, ge_target_email, sharepoint_site_url FROM (
    SELECT *, row_number() OVER (PARTITION BY gws_email ORDER BY line_no DESC) AS rk
    FROM normalized WHERE gws_email IS NOT NULL)
  WHERE rk = 1)"""


def mapped(source: str = "books") -> str:
    """Owners mapped; needs the common table ``identity``."""
    return rf"""mapped AS (
  SELECT b.*, coalesce(i.m365_upn, b.owner_email) AS m365_upn,
         coalesce(i.ge_target_email, i.m365_upn, b.owner_email) AS ge_target_email,
         coalesce(i.sharepoint_site_url, {SITE} || b.owner_email) AS sharepoint_site_url
  FROM {source} b LEFT JOIN identity i ON i.gws_email = b.owner_email)"""


# pages with absolute links and a link to themselves.
PAGES = r"""linked_pages AS (
  SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         replace(html, 'href="/', 'href="' || regexp_extract(url, '^[a-z]+://[^/?#]*') || '/')
           || '<a href="' || url || '">' AS html
  FROM pages),
hrefs AS (
  SELECT page_id, title, idx, list[idx + 1] AS href
  FROM (SELECT page_id, title, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS list FROM linked_pages),
       LATERAL (SELECT unnest(range(len(list))) AS idx))"""

LINKS = rf"""{PAGES},
absolute AS (
  SELECT page_id, title, href AS url,
         row_number() OVER (PARTITION BY page_id ORDER BY idx) - 1 AS position
  FROM hrefs WHERE href LIKE 'http://%' OR href LIKE 'https://%'),
parts AS (
  SELECT *, regexp_extract(url, '^([^:/?#]+):', 1) AS scheme,
         regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS netloc,
         regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path,
         regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query,
         regexp_extract(url, '^[^#]*#(.*)$', 1) AS fragment
  FROM absolute),
lowered AS (
  SELECT *, lower(netloc) AS h, lower(path) AS p, lower(fragment) AS f,
         regexp_replace(lower(path), '[^a-z0-9]', ' ', 'g') AS path_words,
         list_filter(regexp_extract_all(lower(title), '[a-z0-9]{{3,}}'),
                     lambda w: w NOT IN ({quoted(C.TITLE_STOP_WORDS)})) AS tokens,
         regexp_split_to_array(title, '[{SPACE}]+[-|][{SPACE}]+') AS pieces,
         scheme || '://' || netloc || rtrim(path, '/')
           || CASE WHEN query = '' OR contains(query, 'utm_') OR contains(query, 'locale=') THEN ''
                   ELSE '?' || query END AS canonical,
         NOT (list_has_any([true], list_transform([{quoted(C.BLOCKED_HOSTS)}], lambda b: contains(lower(netloc), b)))
           OR list_has_any([true], list_transform([{quoted(C.BLOCKED_PATHS)}], lambda b: contains(lower(path), b)))
           OR contains(query, 'action=edit') OR contains(query, 'printable=yes')) AS allowed
  FROM parts),
counted AS (
  SELECT *, len(list_filter(tokens, lambda t: contains(path_words, t)))::DOUBLE AS matched,
         CASE WHEN len(pieces) > 1 THEN regexp_extract_all(lower(pieces[-1]), '[a-z0-9]+')
              ELSE [] END AS site_tokens
  FROM lowered),
scored AS (
  SELECT *,
         CASE WHEN f IN ({quoted(C.CONTENT_FRAGMENTS)}) THEN CASE WHEN position = 0 THEN 80.0 ELSE 50.0 END
              WHEN f <> '' THEN 10.0 ELSE 0.0 END::DOUBLE
         + CASE WHEN len(tokens) > 0 THEN matched / len(tokens)::DOUBLE * 40.0::DOUBLE ELSE 0.0::DOUBLE END
         + matched * 8.0::DOUBLE
         + CASE WHEN contains(h || p, '{C.WIKI_HOST_PATH}') AND p = '/wiki/' ||
                  lower(replace({strip(f"string_split(title, '{C.WIKI_TITLE_SUFFIX}')[1]")}, ' ', '_'))
                THEN 100.0 ELSE 0.0 END::DOUBLE
         + CASE WHEN len(list_filter(site_tokens, lambda t: contains(h, t))) > 0 THEN 15.0 ELSE 0.0 END::DOUBLE
         - CASE WHEN p IN ({quoted(C.HOME_PATHS)}) THEN 20.0 ELSE 0.0 END::DOUBLE AS score
  FROM counted),
best AS (
  SELECT page_id, canonical AS source_url, score, position FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, position) AS rk
    FROM scored WHERE allowed AND score > -1.0)
  WHERE rk = 1)"""

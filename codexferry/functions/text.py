"""Text columns: trimming, file names, owners, paths, escaping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexferry import constants as C

# Unicode white space as Python's str.strip and str.split see it.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
)
# Line ends as Python's str.splitlines sees them.
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A lambda variable is never inlined by the optimizer, so an expensive value
    that ``body`` uses many times (or once per array element) is computed once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def nonempty(c: Column) -> Column:
    """NULL for the empty string: ``coalesce(nonempty(a), b)`` is ``a or b``."""
    return F.nullif(c, F.lit(""))


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[nonempty(c) for c in cols[:-1]], cols[-1])


def sanitize_filename(name: Column) -> Column:
    """A name that is safe as a file name on every target system."""
    safe = F.regexp_replace(name, C.FORBIDDEN_FILE_CHARS, "_")
    # Control characters are gone, so the Unicode class is all there is to collapse.
    safe = F.regexp_replace(strip_space(safe), r"(?U)\s+", " ")
    safe = F.substring(F.rtrim(safe, F.lit(". ")), 1, C.MAX_FILE_NAME)
    return first_nonempty(safe, F.lit(C.UNTITLED_FILE))


def infer_owner_email(path: Column, default: Column | str) -> Column:
    """First e-mail address in a path, lower-cased; the default is kept as it is."""
    default = F.lit(default) if isinstance(default, str) else default
    return first_nonempty(F.lower(F.regexp_extract(path, C.EMAIL_PATTERN, 1)), default)


def strip_archive_affixes(owner: Column) -> Column:
    """Drop the prefix and suffix of an archive's name that a greedy match keeps."""
    return F.regexp_replace(owner, C.ARCHIVE_AFFIXES, "")


def base_name(file: Column) -> Column:
    """File name without the metadata or HTML suffix."""
    return F.regexp_replace(file, r"(?s)( metadata\.json|\.html)\z", "")


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1C-\x1F]+"))


def xml_text(text: Column) -> Column:
    """Text for an XML node: no control characters, five characters escaped."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for char, entity in [
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"),
    ]:
        clean = F.replace(clean, F.lit(char), F.lit(entity))
    return clean


def percent_encode_path(path: Column) -> Column:
    """Percent-encode everything but unreserved characters and ``/``."""
    encoded = F.url_encode(path)
    for found, wanted in [("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")]:
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)

"""Document columns built from a row's own blocks; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexferry import constants as C
from codexferry.functions import text as T

BLOCKS_TYPE = "array<struct<type:string,level:int,text:string>>"


def blocks_word_count(blocks: Column) -> Column:
    return F.aggregate(
        blocks, F.lit(0).cast("long"), lambda n, b: n + T.word_count(b["text"]).cast("long")
    )


def note_text(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")


def _paragraph(text: Column, size: Column, color: str, bold: bool) -> Column:
    return F.struct(
        text.alias("text"), size.alias("size"), F.lit(color).alias("color"), F.lit(bold).alias("bold")
    )


def _styled(text: Column, style: tuple[int, str, bool]) -> Column:
    size, color, bold = style
    return _paragraph(text, F.lit(size), color, bold)


def block_style(block: Column) -> Column:
    """Run size, colour and weight of one block."""
    text, level = block["text"], block["level"]
    sizes = [F.when(level == n, size) for n, size in C.HEADING_SIZES.items()]
    size = F.coalesce(*sizes, F.lit(C.HEADING_SIZE_OTHER))
    return (
        F.when(block["type"] == "heading", _paragraph(text, size, C.HEADING_COLOR, True))
        .when(
            block["type"] == "bullet", _styled(F.concat(F.lit(C.DOCX_BULLET), text), C.STYLE_TEXT)
        )
        .otherwise(_styled(text, C.STYLE_TEXT))
    )


def paragraph_styles(
    title: Column,
    source_type: Column,
    owner: Column,
    added: Column,
    source_url: Column,
    channel: Column,
    blocks: Column,
) -> Column:
    """Header lines and blocks of a document as styled paragraphs, in order.

    NULL for ``added`` means "not known"; an empty URL or channel has no line.
    """
    about = F.concat(
        F.lit(C.DOCX_TYPE), source_type,
        F.lit(C.DOCX_OWNER), owner,
        F.lit(C.DOCX_ADDED), F.coalesce(added, F.lit(C.DOCX_UNKNOWN)),
    )
    url = F.concat(F.lit(C.DOCX_URL), source_url)
    about_channel = F.concat(F.lit(C.DOCX_CHANNEL), channel)
    header = F.array(
        _styled(title, C.STYLE_TITLE),
        _styled(about, C.STYLE_ABOUT),
        F.when(source_url != "", _styled(url, C.STYLE_URL)),
        F.when(channel != "", _styled(about_channel, C.STYLE_ABOUT)),
    )
    return F.concat(
        F.filter(header, lambda p: p.isNotNull()), F.transform(blocks, block_style)
    )


def paragraph_xml(p: Column) -> Column:
    return F.concat(
        F.lit('<w:p><w:r><w:rPr><w:sz w:val="'), p["size"].cast("string"),
        F.lit('"/><w:color w:val="'), p["color"], F.lit('"/>'),
        F.when(p["bold"], "<w:b/>").otherwise(""),
        F.lit('</w:rPr><w:t xml:space="preserve">'), T.xml_text(p["text"]),
        F.lit("</w:t></w:r></w:p>"),
    )


def document_xml(paragraphs: Column) -> Column:
    body = F.array_join(F.transform(paragraphs, paragraph_xml), "")
    return F.concat(F.lit(C.DOCX_BODY_OPEN), body, F.lit(C.DOCX_BODY_CLOSE))

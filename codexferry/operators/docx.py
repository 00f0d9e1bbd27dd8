"""Word documents: the XML is built by Spark, Python only packs the three parts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codexferry import constants as C

_PIECE_ROWS = 256


def _pack(document_xml: str) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as package:
        for name, text in [
            ("[Content_Types].xml", C.DOCX_CONTENT_TYPES),
            ("_rels/.rels", C.DOCX_RELS),
            ("word/document.xml", document_xml),
        ]:
            part = zipfile.ZipInfo(name)
            part.compress_type = zipfile.ZIP_DEFLATED
            part.flag_bits |= 0x800  # names are UTF-8
            package.writestr(part, text.encode("utf-8"))
    return buffer.getvalue()


def render_docx(df: DataFrame, xml: str = "document_xml") -> DataFrame:
    """Replace the document XML by ``content``, the packed document."""
    kept = [f for f in df.schema.fields if f.name != xml]
    schema = T.StructType(kept + [T.StructField("content", T.BinaryType())])
    names = [f.name for f in kept]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A batch goes out in pieces: packed documents do not pile up beside it.
            for start in range(0, batch.num_rows, _PIECE_ROWS):
                piece = batch.slice(start, _PIECE_ROWS)
                packed = pa.array([_pack(x.as_py()) for x in piece.column(xml)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(n) for n in names] + [packed], names=names + ["content"]
                )

    return df.mapInArrow(render, schema)

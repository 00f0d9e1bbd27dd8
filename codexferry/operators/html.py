"""HTML to blocks and links: the one parse per page, through Arrow."""

from __future__ import annotations

import html as html_entities
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codexferry import constants as C

# Elements that never hold content, and elements whose text does not count.
_VOID = {
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr",
    "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid",
    "param", "source", "spacer", "track", "wbr",
}
_HIDDEN = {"script", "style", "template", "rt", "rp"}
_BLOCK_TAGS = set(C.BLOCK_TAGS)

BLOCKS_FIELD = T.StructField(
    "blocks",
    T.ArrayType(
        T.StructType(
            [
                T.StructField("type", T.StringType()),
                T.StructField("level", T.IntegerType()),
                T.StructField("text", T.StringType()),
            ]
        )
    ),
)
HREFS_FIELD = T.StructField("hrefs", T.ArrayType(T.StringType()))


class _Page(HTMLParser):
    """Collects the text pieces of a page once; a block is a range of pieces.

    An element stays open until its own end tag or that of an enclosing element,
    so an unclosed paragraph holds what follows it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.pieces: list[str] = []
        self.blocks: list[list] = []  # tag, first piece, end piece
        self.hrefs: list[str] = []
        self._run: list[str] = []
        self._open: list[tuple[str, int | None]] = []
        self._open_count: dict[str, int] = {}
        self._hidden = 0

    def _end_run(self) -> None:
        if self._run:
            piece = "".join(self._run).strip()
            self._run.clear()
            if piece and not self._hidden:
                self.pieces.append(piece)

    def handle_starttag(self, tag, attrs) -> None:
        self._end_run()
        if tag == "a":
            self.hrefs.append(dict(attrs).get("href") or "")
        if tag in _VOID:
            return
        block = None
        if tag in _BLOCK_TAGS:
            block = len(self.blocks)
            self.blocks.append([tag, len(self.pieces), None])
        self._open.append((tag, block))
        self._open_count[tag] = self._open_count.get(tag, 0) + 1
        self._hidden += tag in _HIDDEN

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _close_last(self) -> str:
        tag, block = self._open.pop()
        self._open_count[tag] -= 1
        self._hidden -= tag in _HIDDEN
        if block is not None:
            self.blocks[block][2] = len(self.pieces)
        return tag

    def handle_endtag(self, tag) -> None:
        self._end_run()
        if self._open_count.get(tag):
            while self._close_last() != tag:
                pass

    def handle_data(self, data) -> None:
        self._run.append(data)

    def handle_entityref(self, name) -> None:
        text = html_entities.unescape(f"&{name};")
        self._run.append(f"&{name}" if text == f"&{name};" else text)

    def handle_charref(self, name) -> None:
        self._run.append(html_entities.unescape(f"&#{name};"))

    def handle_comment(self, data) -> None:
        self._end_run()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data) -> None:
        self._end_run()
        if data.upper().startswith("CDATA["):
            self._run.append(data[len("CDATA["):])
            self._end_run()

    def finish(self) -> None:
        self.close()
        self._end_run()
        while self._open:
            self._close_last()


def parse_page(html: str | None) -> tuple[list[tuple], list[str]]:
    """Blocks (type, level, text) and ``a[href]`` values of one page, in order."""
    page = _Page()
    page.feed(html or "")
    page.finish()
    blocks = []
    for tag, first, end in page.blocks:
        text = " ".join(page.pieces[first:end])
        if not text:
            continue
        if tag in C.HEADING_TAGS:
            blocks.append(("heading", int(tag[1]), text))
        else:
            blocks.append(("bullet" if tag == "li" else "paragraph", None, text))
    if not blocks:
        # A page without any block: each line of its text is a paragraph.
        for line in "\n".join(page.pieces).splitlines():
            if line.strip():
                blocks.append(("paragraph", None, line.strip()))
    return blocks, page.hrefs


def _list_array(rows: list[list], build) -> pa.ListArray:
    offsets = [0]
    for row in rows:
        offsets.append(offsets[-1] + len(row))
    flat = [x for row in rows for x in row]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), build(flat))


def _block_structs(flat: list[tuple]) -> pa.StructArray:
    types, levels, texts = zip(*flat) if flat else ((), (), ())
    return pa.StructArray.from_arrays(
        [pa.array(types, pa.string()), pa.array(levels, pa.int32()), pa.array(texts, pa.string())],
        names=["type", "level", "text"],
    )


# A piece of a batch goes out at so many characters of blocks and links, or so many pages.
_PIECE_CHARS, _PIECE_ROWS = 1 << 20, 256


def parse_html(df: DataFrame, html: str = "html", batch_chars: int = _PIECE_CHARS) -> DataFrame:
    """Replace column ``html`` by ``blocks`` and ``hrefs``; other columns pass through.

    What a task holds besides the batch that Spark gives it is one piece of the result,
    whatever the number of pages.
    """
    kept = [f for f in df.schema.fields if f.name != html]
    schema = T.StructType(kept + [BLOCKS_FIELD, HREFS_FIELD])
    names = [f.name for f in kept]

    def with_parsed(batch: pa.RecordBatch, parsed: list) -> pa.RecordBatch:
        blocks = _list_array([b for b, _ in parsed], _block_structs)
        hrefs = _list_array([h for _, h in parsed], lambda x: pa.array(x, pa.string()))
        return pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names] + [blocks, hrefs], names=names + ["blocks", "hrefs"]
        )

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # Nested blocks repeat text: a batch may grow, so it goes out in pieces.
        start, size, parsed = 0, 0, []
        for i, text in enumerate(batch.column(html)):
            blocks, hrefs = parse_page(text.as_py())
            parsed.append((blocks, hrefs))
            size += sum(len(b[2]) for b in blocks) + sum(map(len, hrefs))
            if size >= batch_chars or len(parsed) >= _PIECE_ROWS:
                yield with_parsed(batch.slice(start, len(parsed)), parsed)
                start, size, parsed = i + 1, 0, []
        if parsed:
            yield with_parsed(batch.slice(start), parsed)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pieces(batch)
            del batch  # before the next one is read

    return df.mapInArrow(parse, schema)

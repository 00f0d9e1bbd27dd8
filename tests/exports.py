"""Small export archives for tests."""

import io
import json
import zipfile

HTML_PAGE = (
    "<h1>Solar Panels</h1><p>About <b>solar</b> power.</p>"
    '<a href="https://twitter.com/x">t</a><a href="https://energy.example/solar-panels/#top">s</a>'
)


def zip_bytes(entries, utf8_flag=True):
    """A ZIP of {name: text, bytes or dict}; without the flag names are raw UTF-8 bytes."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, data in entries.items():
            if isinstance(data, dict):
                data = json.dumps(data)
            zf.writestr(zipfile.ZipInfo(name), data)
    raw = bytearray(buffer.getvalue())
    if not utf8_flag:
        # zipfile writes UTF-8 and sets bit 11 for such names: clear it in every header.
        for signature, offset in ((b"PK\x03\x04", 7), (b"PK\x01\x02", 9)):
            at = raw.find(signature)
            while at >= 0:
                raw[at + offset] &= ~0x08 & 0xFF
                at = raw.find(signature, at + 4)
    return bytes(raw)


def notebook(owner, name, sources, title=None, notes=None, artifacts=None, extra=None):
    """Entries of one notebook folder; sources is {base: (metadata, html or None)}."""
    root = f"{owner}/Export/Books/{name}"
    meta = {"title": title if title is not None else name}
    meta.update(extra or {})
    entries = {f"{root}/{name} metadata.json": meta}
    for base, (metadata, html) in sources.items():
        entries[f"{root}/Sources/{base} metadata.json"] = metadata
        if html is not None:
            entries[f"{root}/Sources/{base}.html"] = html
    for base, html in (notes or {}).items():
        entries[f"{root}/Notes/{base}.html"] = html
    for base, metadata in (artifacts or {}).items():
        entries[f"{root}/Artifacts/{base} metadata.json"] = metadata
    return entries


def source(kind="URL", added="2024-01-01", video=None, channel=None):
    inner = {"originalSourceContentType": f"SOURCE_CONTENT_TYPE_{kind}", "sourceAddedTimestamp": added}
    if video:
        inner["youtubeMetadata"] = {"videoId": video, "channelName": channel or ""}
    return {"metadata": inner}

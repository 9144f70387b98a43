"""EPUB 3 archives from Markdown: bytes that depend on nothing but their arguments."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.markup import to_xhtml, xml_text

CREATOR = "folio"
CSS = "body { font-family: serif; line-height: 1.6; margin: 5%; }\ntable { border-collapse: collapse; width: 100%; }\nth, td { border: 1px solid #999; padding: 0.3em; }\nblockquote { border-left: 3px solid #999; margin-left: 0; padding-left: 1em; }\npre { white-space: pre-wrap; }\n"
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'
PAGE = HEAD + '<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="{lang}" xml:lang="{lang}">\n<head><title>{title}</title><link rel="stylesheet" href="{css}" type="text/css"/></head>\n<body>\n{body}\n</body>\n</html>'


def members(title: str, body: str, summary: str, tags: Sequence[str], source: str, language: str, modified: str) -> Iterator[tuple[str, str]]:
    name, lang = xml_text(title), xml_text(language)
    book = uuid.uuid5(uuid.NAMESPACE_URL, f"{title}\0{source}\0{body}")
    yield "META-INF/container.xml", HEAD + '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    items = [("nav", "nav.xhtml", "application/xhtml+xml", ' properties="nav"'), ("ncx", "toc.ncx", "application/x-dtbncx+xml", ""), ("content", "text/content.xhtml", "application/xhtml+xml", ""), ("css", "styles.css", "text/css", "")]
    manifest = "".join(f'<item id="{i}" href="{h}" media-type="{m}"{p}/>' for i, h, m, p in items)
    meta = f'<dc:identifier id="pub-id">urn:uuid:{book}</dc:identifier><dc:title>{name}</dc:title><dc:language>{lang}</dc:language><dc:creator>{CREATOR}</dc:creator><meta property="dcterms:modified">{modified}</meta>'
    yield "OEBPS/content.opf", HEAD + f'<package xmlns="http://www.idpf.org/2007/opf" unique-identifier="pub-id" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{meta}</metadata><manifest>{manifest}</manifest><spine toc="ncx"><itemref idref="nav"/><itemref idref="content"/></spine></package>'
    yield "OEBPS/toc.ncx", HEAD + f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="urn:uuid:{book}"/></head><docTitle><text>{name}</text></docTitle><navMap><navPoint id="p1" playOrder="1"><navLabel><text>{name}</text></navLabel><content src="text/content.xhtml"/></navPoint></navMap></ncx>'
    yield "OEBPS/nav.xhtml", PAGE.format(lang=lang, title=name, css="styles.css", body=f'<nav epub:type="toc"><ol><li><a href="text/content.xhtml">{name}</a></li></ol></nav>')
    yield "OEBPS/styles.css", CSS
    about = [f"<h1>{name}</h1>", *([f"<blockquote>{xml_text(summary)}</blockquote>"] if summary else []), *([f"<p>{', '.join(map(xml_text, tags))}</p>"] if tags else [])]
    yield "OEBPS/text/content.xhtml", PAGE.format(lang=lang, title=name, css="../styles.css", body="\n".join([*about, "<section>", body, "</section>"]))


def book(title: str, markdown: str, summary: str = "", tags: Sequence[str] = (), source: str = "", language: str = "zh-TW", modified: str = "2024-01-01T00:00:00Z") -> bytes:
    """The archive; its type comes first and uncompressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        stamp = (2024, 1, 1, 0, 0, 0)
        archive.writestr(zipfile.ZipInfo("mimetype", stamp), "application/epub+zip", zipfile.ZIP_STORED)
        for name, data in members(title, to_xhtml(markdown), summary, tags, source, language, modified):
            archive.writestr(zipfile.ZipInfo(name, stamp), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def _books(title: pd.Series, markdown: pd.Series, summary: pd.Series, tags: pd.Series, source: pd.Series, language: pd.Series, modified: pd.Series) -> pd.Series:
    rows = zip(title, markdown, summary, tags, source, language, modified)
    return pd.Series([book(t or "", m or "", s or "", [] if g is None else list(g), f or "", lang, at) for t, m, s, g, f, lang, at in rows])


def epub(title: Column, markdown: Column, *, summary: Column | None = None, tags: Column | None = None, source: Column | None = None, language: str = "zh-TW", modified: str = "2024-01-01T00:00:00Z") -> Column:
    """Bytes of an EPUB per row."""
    none = F.lit("")
    return _books(title, markdown, summary if summary is not None else none, tags if tags is not None else F.array().cast("array<string>"), source if source is not None else none, F.lit(language), F.lit(modified))

"""PDF by an optional library: page texts, tables as elements, page images. Without it every file is a scan without text."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

from folio.sources.archives import Warn, cell

MAX_IMAGE = 1600


def opened(content: bytes, password: str | None = None):
    import fitz

    document = fitz.open(stream=content, filetype="pdf")
    if document.needs_pass and not document.authenticate(password or ""):
        raise PermissionError("the file is encrypted and the password doesn't open it")
    return document


def available() -> bool:
    import importlib.util

    return importlib.util.find_spec("fitz") is not None


def page_texts(content: bytes, password: str | None = None) -> list[str]:
    with opened(content, password) as document:
        return [page.get_text() for page in document]


def page_count(content: bytes, password: str | None = None) -> int:
    """Pages, 1 where the file can't be read."""
    try:
        with opened(content, password) as document:
            return document.page_count
    except Exception:  # noqa: BLE001 - missing library, broken or locked file
        return 1


def has_tables(content: bytes, password: str | None = None) -> bool:
    """Whether any page has a table; stops at the first, False on failure."""
    try:
        with opened(content, password) as document:
            return any(page.find_tables().tables for page in document)
    except Exception:  # noqa: BLE001
        return False


def page_elements(content: bytes, password: str | None = None) -> Iterator[dict]:
    """Tables with their boxes and words, and text blocks, as rows for ``folio.operators.layout``."""
    with opened(content, password) as document:
        for number, page in enumerate(document, 1):
            seq = 0
            for table in page.find_tables().tables:
                rows = table.extract() or []
                if table.header is None or not rows:
                    continue
                external = table.header.external and table.header.names
                x0, y0, x1, y1 = table.bbox
                boxes = [[None if c is None else {"x0": c[0], "x1": c[2]} for c in r.cells] for r in table.rows]
                words = [[{"x0": w[0], "y0": w[1], "x1": w[2], "text": w[4]} for w in page.get_text("words", clip=r.bbox)] for r in table.rows]
                yield {"page": number, "seq": seq, "kind": "table", "y": y0, "y1": y1, "x0": x0, "x1": x1, "header": [cell(c) for c in (table.header.names if external else rows[0])], "rows": rows if external else rows[1:], "boxes": boxes, "words": words, "text": None}
                seq += 1
            for block in page.get_text("blocks"):
                if block[4].strip():
                    yield {"page": number, "seq": seq, "kind": "text", "y": block[1], "y1": block[3], "x0": block[0], "x1": block[2], "header": None, "rows": None, "boxes": None, "words": None, "text": block[4].strip()}
                    seq += 1


def page_images(content: bytes, password: str | None = None, dpi: int = 200, pages: int = 15) -> list[bytes]:
    """The first pages as RGB PNG, at most ``MAX_IMAGE`` pixels on a side."""
    import fitz

    out = []
    with opened(content, password) as document:
        for page in list(document)[:pages]:
            scale = min(dpi / 72, MAX_IMAGE / max(page.rect.width, page.rect.height))
            out.append(page.get_pixmap(matrix=fitz.Matrix(scale, scale), colorspace=fitz.csRGB, alpha=False).tobytes("png"))
    return out


def decrypted(content: bytes, password: str) -> bytes:
    """The file without its password."""
    import pikepdf

    out = io.BytesIO()
    with pikepdf.open(io.BytesIO(content), password=password) as file:
        file.save(out)
    return out.getvalue()


def pdf_text(content: bytes, warn: Warn, password: str | None = None) -> str:
    if not available():
        warn("no PDF library on the executors; the file counts as a scan")
        return ""
    return "".join(page_texts(content, password))


def layout_text(convert: Callable[[bytes], str] | None, content: bytes, warn: Warn) -> str:
    """A layout tool's Markdown, '' where there is no tool or it fails."""
    if convert is None:
        return ""
    try:
        return convert(content)
    except Exception as e:  # noqa: BLE001 - an external tool's failure isn't the file's
        warn(f"layout tool: {e}")
        return ""

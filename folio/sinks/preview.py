"""HTML previews of written Markdown: of a column, or of one file behind a guard of its path and size."""

from __future__ import annotations

import os

from folio.functions.markup import MAX_PREVIEW_BYTES, markdown_to_html, to_html

__all__ = ["markdown_to_html", "preview_file"]


def preview_file(path: str) -> str | None:
    """The preview of a regular file of at most ``MAX_PREVIEW_BYTES`` at an absolute path, None for anything else."""
    if not os.path.isabs(path) or not os.path.isfile(path) or os.path.getsize(path) > MAX_PREVIEW_BYTES:
        return None
    with open(path, encoding="utf-8", errors="replace") as file:
        return to_html(file.read())

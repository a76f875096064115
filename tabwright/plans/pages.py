"""A folder of JSON lines served like a paged web answer."""

from __future__ import annotations


def fetch_lines(url: str, method: str, headers: dict, body: str | None) -> str:
    """Serve a folder of JSON-lines parts as one page, shaped like a paged web answer."""
    import pathlib
    from urllib.parse import unquote, urlsplit
    parts = sorted(pathlib.Path(unquote(urlsplit(url).path)).glob("part-*"))
    if not parts:
        return '{"data": {"items": []}}'
    lines = [line for part in parts for line in part.read_text(encoding="utf-8").splitlines() if line]
    return '{"data": {"items": [' + ",".join(lines) + "]}}"

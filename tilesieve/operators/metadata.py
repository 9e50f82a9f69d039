"""Overrides of an archive's metadata."""

from __future__ import annotations

import json


def apply_overrides(base: str, name: str | None = None, description: str | None = None, attribution: str | None = None) -> str:
    """The metadata with what is given replaced, and all else kept; what is no JSON object counts as an empty one."""
    try:
        doc = json.loads(base)
    except ValueError:
        doc = None
    doc = dict(doc) if isinstance(doc, dict) else {}
    doc |= {k: v for k, v in (("name", name), ("description", description), ("attribution", attribution)) if v is not None}
    return json.dumps(doc, ensure_ascii=False)

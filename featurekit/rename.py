"""Templating of an extension repository (C10 and D11 of the inventory): ordered replacements over its text files."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from pathlib import Path

TEXT = (".md", ".json", ".yaml", ".yml", ".txt", ".toml", ".py", ".csv")
SKIPPED = {".git", "node_modules", "__pycache__"}


def slug(title: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-")


def replacements(title: str, prefix: str, name: str | None = None, org: str | None = None, domain: str | None = None, template: Sequence[str] = ("Template", "template", "template")) -> list[tuple[str, str]]:
    """Pairs to replace, longer ones first: repository, address, title, property prefix."""
    old_title, old_slug, old_prefix = template
    new = name or slug(title)
    out = [(f"{old_slug}-extension", f"{new}-extension"), (f"{old_title} Extension", f"{title} Extension"), (f"{old_prefix}:", f"{prefix}:")]
    if org:
        out.append(("ORGANISATION", org))
    if domain:
        out.append(("DOMAIN", domain))
    return sorted(out, key=lambda x: -len(x[0]))


def rename_extension(folder: str, pairs: Sequence[tuple[str, str]]) -> list[str]:
    """Replaces in every text file below the folder, in order; a file that can't be changed warns and the others go on."""
    changed = []
    for path in sorted(Path(folder).rglob("*")):
        if not path.is_file() or path.suffix.lower() not in TEXT or SKIPPED & set(path.parts):
            continue
        try:
            old = text = path.read_text(encoding="utf-8")
            for a, b in pairs:
                text = text.replace(a, b)
            if text != old:
                path.write_text(text, encoding="utf-8")
                changed.append(str(path))
        except (OSError, UnicodeDecodeError) as e:
            warnings.warn(f"{path}: {e}", stacklevel=2)
    return changed

"""A file's tags while they are read: group, name and value, under limits, with warnings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Limits of a file's tags.
MOST_TAGS, MOST_VALUE, MOST_TOTAL, MOST_WARNINGS = 4096, 1 << 20, 8 << 20, 64

_OTHER = re.compile(r"[^A-Za-z0-9_-]+")


def tag_name(raw: str) -> str:
    out = "".join(w[0].upper() + w[1:] for w in _OTHER.split(raw) if w)
    return "Tag" + out if len(out) < 2 or out[0].isdigit() else out


def clean(s: str) -> str:
    end = len(s)
    while end and (s[end - 1] == "\0" or s[end - 1].isspace()):
        end -= 1
    return s[:end]


def text_of(b: bytes) -> str:
    """UTF-8 where it is valid, else Latin-1."""
    try:
        return b.decode("utf-8")
    except UnicodeDecodeError:
        return b.decode("latin-1")


def zero_ended(b: bytes) -> str:
    return clean(text_of(b.split(b"\0", 1)[0]))


@dataclass
class Tags:
    tags: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    icc: bytes | None = None
    total: int = 0

    def push(self, group: str, name: str, value: int | float | str | list[str]) -> None:
        if len(self.tags) >= MOST_TAGS:
            return
        kind = {int: "int", float: "real", str: "text", list: "list"}[type(value)]
        if kind == "text":
            value = value.encode("utf-8", "replace")[:MOST_VALUE].decode("utf-8", "ignore")
        size = len(value) if kind == "text" else sum(map(len, value)) if kind == "list" else 8
        if self.total + size > MOST_TOTAL or (kind == "list" and size > MOST_VALUE):
            self.warn("metadata size limit")
            return
        self.total += size
        self.tags.append({"pos": len(self.tags), "tag_group": group, "name": name, "kind": kind, "i": value if kind == "int" else None, "r": value if kind == "real" else None, "s": value if kind == "text" else None, "l": value if kind == "list" else None})

    def text(self, group: str, name: str, value: str) -> None:
        if value:
            self.push(group, name, value)

    def warn(self, what: str) -> None:
        if len(self.warnings) < MOST_WARNINGS:
            self.warnings.append(what)

    def profile(self, data: bytes) -> None:
        """Tags of the first colour profile."""
        if self.icc is not None:
            return
        self.icc = data
        from . import icc

        try:
            p = icc.Profile(data)
        except Exception:  # noqa: BLE001  a damaged profile is a warning here
            self.warn("invalid ICC profile")
            return
        self.text("ICC_Profile", "ProfileDescription", p.description or "")
        self.text("ICC-header", "ProfileID", " ".join(map(str, data[84:100])))
        self.text("ICC-header", "ColorSpaceData", p.space.decode("utf-8", "replace").rstrip())

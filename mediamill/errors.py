"""Errors of a kernel and how a row reports them."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any


class MediaError(Exception):
    kind = "Invalid"


class Invalid(MediaError):
    """The bytes aren't what they should be."""


class Limit(MediaError):
    """The bytes ask for more than a row may use."""

    kind = "Limit"


class Deadline:
    """A row's time budget; kernels ask for it between blocks of work."""

    def __init__(self, seconds: float | None = None):
        self.end = None if seconds is None else time.monotonic() + seconds

    def check(self) -> None:
        if self.end is not None and time.monotonic() > self.end:
            raise Limit("deadline")


def guarded(f: Callable[..., Any], *args: Any) -> dict[str, Any]:
    """A kernel's result or its error: ``ok, error_class, error, value``; one bad row doesn't fail its task."""
    try:
        return {"ok": True, "error_class": None, "error": None, "value": f(*args)}
    except MediaError as e:
        return {"ok": False, "error_class": e.kind, "error": str(e), "value": None}
    except Exception as e:  # noqa: BLE001  a kernel's own mistake must not take other rows with it
        return {"ok": False, "error_class": "Internal", "error": type(e).__name__, "value": None}

"""Kernels timed on single files, one thread: milliseconds a file, the median of some samples."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable

from . import composers, synth
from .kernels import jpeg, meta, pdf_render, pdf_write, png, sanitize


def median_ms(work: Callable[[], object], samples: int) -> float:
    """Median wall time of so many runs in milliseconds."""
    took = []
    for _ in range(samples):
        began = time.perf_counter()
        work()
        took.append((time.perf_counter() - began) * 1000)
    return round(statistics.median(took), 3)


def files(sides: tuple[int, ...] = (1400, 3000)) -> dict[str, bytes]:
    """Photos of gradients, rings and noise as JPEG and PNG, a scan of three pages, two pages of text."""
    out: dict[str, bytes] = {}
    for side in sides:
        picture = synth.photo(side, side, side)
        out[f"cover_{side}.jpg"] = jpeg.encode(picture, 95)
        if side == max(sides):
            out[f"cover_{side}.png"] = png.encode(picture)
    scan = jpeg.encode(synth.photo(850, 1100, 7), 85)
    out["document_scan_3p.pdf"] = pdf_write.image_pdf([(850, 1100, scan)] * 3)
    out["document_text_1p.pdf"] = composers.text_page("truetype", 10, 20, 1)
    return out


def timings(samples: int = 3) -> dict[str, float]:
    """Milliseconds by file and operation."""
    out = {}
    for name, data in files().items():
        if name.endswith(".pdf"):
            out[f"{name} / pdf sanitize"] = median_ms(lambda d=data: pdf_render.sanitize(d), 1)
            continue
        n = 1 if "3000" in name else samples
        kind = "png" if name.endswith("png") else "jpeg"
        steps = {"probe": sanitize.probe, "metadata": meta.read, "qr": sanitize.qr_count, "cover": sanitize.inspect, "sanitize": lambda d, k=kind: sanitize.sanitize(d, k)}
        for step, work in steps.items():
            out[f"{name} / {step}"] = median_ms(lambda w=work, d=data: w(d), n if step not in ("probe", "metadata") else 5)
    return out

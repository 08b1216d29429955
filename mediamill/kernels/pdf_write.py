"""A writer for documents that hold nothing but page images."""

from __future__ import annotations

from ..errors import Limit

MAX_OUTPUT = 64 << 20
MAX_PIXELS = 64_000_000
LONG_SIDE = 792.0


def image_pdf(pages: list[tuple[int, int, bytes]], max_output: int = MAX_OUTPUT) -> bytes:
    """A document of one JPEG a page (``w, h, jpeg``), each page's long side 792 points."""
    kids = " ".join(f"{3 + 3 * i} 0 R" for i in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{kids}] >>".encode()]
    total = 0
    for i, (w, h, jpeg) in enumerate(pages):
        total += w * h
        if total > MAX_PIXELS:
            raise Limit("document pixel budget exceeded")
        n, scale = 3 + 3 * i, LONG_SIDE / max(w, h)
        size = f"{w * scale:.4f}", f"{h * scale:.4f}"
        draw = f"q {size[0]} 0 0 {size[1]} 0 0 cm /Im0 Do Q".encode()
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {size[0]} {size[1]}] /Resources << /XObject << /Im0 {n + 1} 0 R >> >> /Contents {n + 2} 0 R >>".encode())
        objects.append(f"<< /Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode /Length {len(jpeg)} >>\nstream\n".encode() + jpeg + b"\nendstream")
        objects.append(f"<< /Length {len(draw)} >>\nstream\n".encode() + draw + b"\nendstream")
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
        if len(out) > max_output:
            raise Limit("document derivative exceeded limit")
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()
    return bytes(out)

"""Stream filters of PDF: hexadecimal, base 85, run length, LZW, Flate with predictors, DCT, CCITT fax, JBIG2."""

from __future__ import annotations

import re
import zlib

import numpy as np

from ..errors import Invalid, Limit
from . import ccitt, deflate

MOST_OUTPUT = 256 << 20
# Short names of filters in inline images.
SHORT = {"AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "Fl": "FlateDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}


def ascii_hex(data: bytes) -> bytes:
    body = re.sub(rb"[\x00\s]", b"", data.split(b">", 1)[0])
    if re.search(rb"[^0-9A-Fa-f]", body):
        raise Invalid("hexadecimal stream")
    return bytes.fromhex((body + b"0" * (len(body) % 2)).decode())


def ascii_85(data: bytes) -> bytes:
    body = re.sub(rb"[\x00\s]", b"", data.split(b"~", 1)[0]).removeprefix(b"<~")
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += _five(group)
                group = []
        else:
            raise Invalid("base 85 stream")
    if len(group) == 1:
        raise Invalid("base 85 stream")
    if group:
        out += _five(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _five(group: list[int]) -> bytes:
    v = 0
    for g in group:
        v = v * 85 + g
    if v >> 32:
        raise Invalid("base 85 stream")
    return v.to_bytes(4, "big")


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def lzw(data: bytes, early: int = 1) -> bytes:
    """Variable codes from 9 to 12 bits; with ``early`` they widen a code before it's needed."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, bits, acc, width, last = bytearray(), 0, 0, 9, b""
    for byte in data:
        acc, bits = acc << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            break
        out += entry
        if len(out) > MOST_OUTPUT:
            raise Limit("inflated size exceeded")
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        size = len(table) + early
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return bytes(out)


def flate(data: bytes) -> bytes:
    """A zlib stream, a raw one if its header is wrong, and whatever comes before damage."""
    try:
        out, _, whole = deflate.inflate(data, MOST_OUTPUT)
        if whole or out:
            return out
    except Invalid:
        pass
    out = deflate.salvage(data, MOST_OUTPUT, raw=False)
    if not out:
        out = deflate.salvage(data[2:], MOST_OUTPUT, raw=True) or deflate.salvage(data, MOST_OUTPUT, raw=True)
    if not out and data:
        try:
            zlib.decompress(data)
        except zlib.error:
            raise Invalid("damaged deflate stream") from None
    return out


def predict(data: bytes, params: dict) -> bytes:
    """Undo a TIFF or PNG predictor."""
    kind = int(params.get("Predictor", 1))
    if kind < 2:
        return data
    colors, bits, columns = int(params.get("Colors", 1)), int(params.get("BitsPerComponent", 8)), int(params.get("Columns", 1))
    if not (1 <= colors <= 32 and bits in (1, 2, 4, 8, 16) and 1 <= columns <= 1 << 24):
        raise Invalid("predictor")
    line, bpp = (colors * bits * columns + 7) // 8, max(1, colors * bits // 8)
    if kind == 2:
        return _tiff(data, line, colors, bits, columns)
    from .png import unfilter

    rows = len(data) // (line + 1)
    rest = len(data) - rows * (line + 1)
    if rest > 1:  # a last row that was cut off counts with zeros behind it
        data, rows = data + bytes(line + 1 - rest), rows + 1
    if not rows:
        return b""
    raw = np.frombuffer(data, dtype=np.uint8, count=rows * (line + 1)).reshape(rows, line + 1).copy()
    raw[raw[:, 0] > 4, 0] = 0
    out = unfilter(raw, rows, line, bpp).tobytes()
    return out[: len(out) - (line + 1 - rest if rest > 1 else 0)]


def _tiff(data: bytes, line: int, colors: int, bits: int, columns: int) -> bytes:
    rows = -(-len(data) // line)
    raw = np.frombuffer(data.ljust(rows * line, b"\0"), dtype=np.uint8).reshape(rows, line)
    if bits == 8:
        out = np.cumsum(raw[:, : columns * colors].reshape(rows, columns, colors), axis=1, dtype=np.uint8).reshape(rows, -1)
    elif bits == 16:
        out = np.cumsum(raw.view(">u2")[:, : columns * colors].reshape(rows, columns, colors), axis=1, dtype=np.uint16).astype(">u2").view(np.uint8).reshape(rows, -1)
    else:
        planes = np.unpackbits(raw, axis=1)[:, : columns * colors * bits].reshape(rows, columns, colors, bits)
        values = (planes * (1 << np.arange(bits - 1, -1, -1))).sum(axis=3)
        values = np.cumsum(values, axis=1) & ((1 << bits) - 1)
        back = (values[..., None] >> np.arange(bits - 1, -1, -1)) & 1
        out = np.packbits(back.reshape(rows, -1).astype(np.uint8), axis=1)
    return out.tobytes()[: len(data)]


def apply(name: str, data: bytes, params: dict) -> bytes:
    """One filter's output; image filters give the bytes of their samples."""
    name = SHORT.get(name, name)
    if name == "ASCIIHexDecode":
        return ascii_hex(data)
    if name == "ASCII85Decode":
        return ascii_85(data)
    if name == "RunLengthDecode":
        return run_length(data)
    if name == "LZWDecode":
        return predict(lzw(data, int(params.get("EarlyChange", 1))), params)
    if name == "FlateDecode":
        return predict(flate(data), params)
    if name == "DCTDecode":
        from .jpeg import decode

        return decode(data)[1].data.tobytes()
    if name == "CCITTFaxDecode":
        return ccitt.decode(data, int(params.get("K", 0)), int(params.get("Columns", 1728)), int(params.get("Rows", 0)), bool(params.get("BlackIs1", False)), bool(params.get("EncodedByteAlign", False)))
    if name == "JBIG2Decode":
        from .jbig2 import decode as decode_bilevel

        return np.packbits(~decode_bilevel(data, params.get("JBIG2Globals") or b""), axis=1).tobytes()
    if name == "Crypt":
        return data
    raise Invalid(f"unsupported filter {name}")

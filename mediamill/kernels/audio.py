"""Tags of audio containers: RIFF, AIFF, FLAC, WavPack, TTA, MP4, ID3, APE, Vorbis comments."""

from __future__ import annotations

import struct

from ..errors import Invalid
from . import deflate, parts, xmp
from .tags import MOST_TAGS, MOST_VALUE, Tags, clean, tag_name, zero_ended

MOST_ATOMS, MOST_DEPTH = 65_536, 16

# Names of the tags of each container.
RIFF_NAMES = {"IARL": "ArchivalLocation", "IART": "Artist", "ICMS": "Commissioned", "ICMT": "Comment", "ICOP": "Copyright", "ICRD": "DateCreated", "IENG": "Engineer", "IGNR": "Genre", "IKEY": "Keywords", "IMED": "Medium", "INAM": "Title", "IPRD": "Product", "ISBJ": "Subject", "ISFT": "Software", "ISRC": "Source", "ISRF": "SourceForm", "ITCH": "Technician", "ITRK": "TrackNumber", "IPRT": "TrackNumber"}
AIFF_NAMES = {b"NAME": "Name", b"AUTH": "Author", b"(c) ": "Copyright", b"ANNO": "Annotation"}
VORBIS_NAMES = {"ISRC": "ISRC", "TRACKNUMBER": "TrackNumber", "ENCODED_USING": "EncodedUsing", "ENCODED_BY": "EncodedBy"} | {n.upper(): n for n in ("Title", "Version", "Album", "Artist", "Performer", "Copyright", "License", "Organization", "Description", "Genre", "Date", "Location", "Contact", "Comment", "Encoder", "Composer", "Software")}
APE_NAMES = {"tool name": "ToolName", "tool version": "ToolVersion", "encoder": "Encoder", "comment": "Comment", "description": "Description", "software": "Software"}
ID3_NAMES = {"TIT2": "Title", "TPE1": "Artist", "TPE2": "Band", "TALB": "Album", "TCOM": "Composer", "TCON": "Genre", "TYER": "Year", "TDRC": "RecordingTime", "TRCK": "Track", "TCOP": "Copyright", "TPUB": "Publisher", "TSRC": "ISRC", "TENC": "EncodedBy", "TSSE": "EncoderSettings", "TIT3": "Subtitle", "TEXT": "Lyricist", "TOWN": "FileOwner"}
ID3_SHORT = {"TT2": "TIT2", "TP1": "TPE1", "TP2": "TPE2", "TAL": "TALB", "TCM": "TCOM", "TCO": "TCON", "TYE": "TYER", "TRK": "TRCK", "TCR": "TCOP", "TPB": "TPUB", "TRC": "TSRC", "TEN": "TENC", "TSS": "TSSE", "TT3": "TIT3", "TXT": "TEXT", "TXX": "TXXX", "COM": "COMM"}
ID3_ALIASES = {"encoder": "Encoder", "encoded_by": "Encoder", "encodedby": "Encoder", "software": "Software", "writing_library": "Software", "creator_tool": "CreatorTool", "creatortool": "CreatorTool", "comment": "Comment", "description": "Description"}
MP4_NAMES = {b"\xa9too": "Encoder", b"\xa9cmt": "Comment", b"desc": "Description", b"\xa9des": "Description", b"\xa9swr": "SoftwareVersion", b"\xa9enc": "EncodedBy", b"\xa9nam": "Title", b"\xa9ART": "Artist", b"aART": "AlbumArtist", b"\xa9alb": "Album", b"\xa9wrt": "Composer", b"\xa9day": "ContentCreateDate", b"\xa9gen": "Genre", b"cprt": "Copyright", b"\xa9lyr": "Lyrics"}
#: First byte and end of each text of a broadcast chunk.
BEXT_FIELDS = {"Description": (0, 256), "Originator": (256, 288), "OriginatorReference": (288, 320), "CodingHistory": (602, None)}
RIFF_HEAD, RIFF_TRAILER = b"\x21", b"\x22"
MP4_FOLDERS = (b"moov", b"udta", b"trak", b"mdia", b"minf", b"meta")
MP4_TEXT = {1: "utf-8", 2: "utf-16-be"}
XMP_UUID = bytes.fromhex("BE7ACFCB97A942E89C71999491E3AFAC")


# --- ID3 --------------------------------------------------------------------------------------------------------------


def syncsafe(b: bytes) -> int | None:
    if len(b) < 4 or any(x > 127 for x in b[:4]):
        return None
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3_size(d: bytes) -> int:
    """Bytes of an ID3v2 tag in front, 0 if there is none."""
    if d[:3] != b"ID3" or len(d) < 10:
        return 0
    size = syncsafe(d[6:10])
    if size is None:
        return 0
    return min(len(d), 10 + size + (10 if d[5] & 0x10 else 0))


def unsync(d: bytes) -> bytes:
    return d.replace(b"\xff\x00", b"\xff")


def _decode(code: int, b: bytes) -> str:
    if code in (1, 2):
        order = "be" if code == 2 else "le"
        if b[:2] in (b"\xff\xfe", b"\xfe\xff"):
            order, b = ("le" if b[:1] == b"\xff" else "be"), b[2:]
        return b[: len(b) // 2 * 2].decode(f"utf-16-{order}", "replace")
    return b.decode("utf-8", "replace") if code == 3 else b.decode("latin-1")


def _split(code: int, b: bytes) -> tuple[bytes, bytes]:
    """A text and what follows its terminator."""
    if code in (1, 2):
        for i in range(0, len(b) - 1, 2):
            if b[i : i + 2] == b"\0\0":
                return b[:i], b[i + 2 :]
        return b, b""
    a, _, c = b.partition(b"\0")
    return a, c


def _joined(code: int, b: bytes) -> str:
    return clean(_decode(code, b).rstrip("\0").replace("\0", "/"))


def id3v2(d: bytes, out: Tags) -> None:
    size = id3_size(d)
    if size < 10:
        return
    major, flags = d[3], d[5]
    body = d[10:size]
    if flags & 0x80 and major < 4:
        body = unsync(body)
    at = 0
    if flags & 0x40 and len(body) >= 4:
        at = (syncsafe(body) or 0) if major == 4 else struct.unpack_from(">I", body)[0] + 4
    letters, head = (3, 6) if major == 2 else (4, 10)
    for _ in range(2048):
        if at + head > len(body) or not body[at]:
            return
        name = body[at : at + letters]
        if not all(65 <= c <= 90 or 48 <= c <= 57 for c in name):
            out.warn("invalid ID3 frame id")
            return
        raw = body[at + letters : at + 2 * letters]
        size = syncsafe(raw) if major >= 4 else int.from_bytes(raw, "big")
        mode = body[at + 9] if major > 2 else 0
        start = at + head
        if size is None or start + size > len(body):
            out.warn("truncated ID3 frame")
            return
        at = start + size
        f = body[start:at]
        if major == 4:
            if mode & 0x04:
                continue
            if mode & 0x02 or flags & 0x80:
                f = unsync(f)
            if mode & 0x01:
                f = f[4:]
            if mode & 0x08:
                try:
                    f = deflate.inflate(f, MOST_VALUE)[0]
                except Exception:  # noqa: BLE001  a frame that doesn't inflate is left out
                    continue
        elif major == 3 and mode & 0xC0:
            continue
        _frame(name.decode(), f, f"ID3v2_{major}", out)


def _frame(name: str, f: bytes, group: str, out: Tags) -> None:
    full = ID3_SHORT.get(name, name)
    if not f:
        return
    code, rest = f[0], f[1:]
    if full == "TXXX":
        what, value = _split(code, rest)
        what, value = _decode(code, what), _joined(code, value)
        out.text(group, "UserDefinedText", f"({what}) {value}")
        if what.lower() in ID3_ALIASES:
            out.text(group, ID3_ALIASES[what.lower()], value)
    elif full == "COMM":
        if len(rest) >= 3:
            out.text(group, "Comment", clean(_decode(code, _split(code, rest[3:])[1])))
    elif full == "PRIV":
        owner, data = _split(0, f)
        if owner == b"XMP":
            xmp.read(data, out)
    elif name[0] == "T":
        value = _joined(code, rest)
        out.text(group, ID3_NAMES.get(full) or tag_name(name), value)
        if full == "TSSE":
            out.text(group, "Encoder", value)


def id3v1(d: bytes, out: Tags) -> int:
    """Fixed fields of the last 128 bytes; how many bytes they take."""
    t = d[-128:]
    if len(t) < 128 or t[:3] != b"TAG":
        return 0
    end = 125 if not t[125] and t[126] else 127
    for name, a, b in (("Title", 3, 33), ("Artist", 33, 63), ("Album", 63, 93), ("Year", 93, 97), ("Comment", 97, end)):
        out.text("ID3v1", name, clean(t[a:b].split(b"\0", 1)[0].decode("latin-1")))
    return 128


def ape(d: bytes, end: int, out: Tags) -> None:
    """Items of the tag whose footer ends at a place."""
    if end < 32 or d[end - 32 : end - 24] != b"APETAGEX":
        return
    size, count = struct.unpack_from("<II", d, end - 20)
    if not 32 <= size <= end:
        out.warn("invalid APE tag size")
        return
    items, at = d[end - size : end - 32], 0
    for _ in range(min(count, 1024)):
        zero = items.find(b"\0", at + 8)
        if at + 8 > len(items) or zero < 0:
            return
        length, flags = struct.unpack_from("<II", items, at)
        key, value = items[at + 8 : zero].decode("utf-8", "replace"), items[zero + 1 : zero + 1 + length]
        if len(value) < length:
            out.warn("truncated APE item")
            return
        at = zero + 1 + length
        if not flags >> 1 & 3:
            out.text("APE", APE_NAMES.get(key.lower()) or tag_name(key), clean(value.decode("utf-8", "replace").replace("\0", "/")))


def _tail(d: bytes, out: Tags) -> None:
    ape(d, len(d) - id3v1(d, out), out)


# --- containers: what is read of which part ----------------------------------------------------------------------------


def _cut_off(out: Tags, samples: bytes = b""):
    """Warn of a part that the file's end cuts off, unless it holds the samples, which metadata don't need."""
    return lambda name: None if name == samples else out.warn(f"part {name.decode('latin-1')!r} is cut off")


def _each(d: bytes, at: int, head: parts.Head, readers: dict, out: Tags, samples: bytes = b"") -> None:
    for name, body in parts.walk(d, at, head, _cut_off(out, samples)):
        if read := readers.get(name):
            read(body, out)


def _riff_list(body: bytes, out: Tags) -> None:
    if body[:4] != b"INFO":
        return
    for key, value in parts.walk(body, 4, parts.iff("little")):
        name = key.decode("latin-1")
        out.text("RIFF", RIFF_NAMES.get(name) or tag_name(name), zero_ended(value))


def _riff_broadcast(body: bytes, out: Tags) -> None:
    if len(body) < BEXT_FIELDS["CodingHistory"][0]:
        return
    for name, (first, end) in BEXT_FIELDS.items():
        out.text("RIFF", name, zero_ended(body[first:end]))


def _riff_format(body: bytes, out: Tags) -> None:
    if len(body) >= 16:
        out.push("RIFF", "BitsPerSample", int.from_bytes(body[14:16], "little"))


def _xmp(body: bytes, out: Tags) -> None:
    xmp.read(body, out)


RIFF_PARTS = {b"LIST": _riff_list, b"bext": _riff_broadcast, b"fmt ": _riff_format, b"id3 ": id3v2, b"ID3 ": id3v2, b"_PMX": _xmp}


def _riff_parts(d: bytes, out: Tags) -> None:
    _each(d, 0, parts.iff("little"), RIFF_PARTS, out, b"data")


def riff(d: bytes, out: Tags) -> None:
    if d[:4] not in (b"RIFF", b"RF64") or d[8:12] != b"WAVE":
        raise Invalid("not a WAVE file")
    _riff_parts(d[12:], out)


def _aiff_comments(body: bytes, out: Tags) -> None:
    """A count, then for each comment a time, a marker, a length and its text, padded to an even length."""
    at = 2
    for _ in range(int.from_bytes(body[:2], "big")):
        end = at + 8 + int.from_bytes(body[at + 6 : at + 8], "big")
        if at + 8 > len(body) or end > len(body):
            return
        out.text("AIFF", "Comment", zero_ended(body[at + 8 : end]))
        at = end + (end - at & 1)


AIFF_PARTS = {chunk: (lambda body, out, name=name: out.text("AIFF", name, zero_ended(body))) for chunk, name in AIFF_NAMES.items()} | {b"COMT": _aiff_comments, b"ID3 ": id3v2}


def aiff(d: bytes, out: Tags) -> None:
    if d[:4] != b"FORM" or len(d) < 12:
        raise Invalid("not an AIFF file")
    _each(d, 12, parts.iff("big"), AIFF_PARTS, out, b"SSND")


def vorbis(b: bytes, out: Tags) -> None:
    """The maker, then a count of lines ``KEY=value``; every text has a 32-bit length in front."""
    at = 0

    def number() -> int | None:
        nonlocal at
        at += 4
        return int.from_bytes(b[at - 4 : at], "little") if at <= len(b) else None

    def text() -> str | None:
        nonlocal at
        size = number()
        if size is None:
            return None
        at += size
        if at > len(b):
            out.warn("a Vorbis comment is cut off")
            return None
        return b[at - size : at].decode("utf-8", "replace")

    maker = text()
    if maker is None:
        return
    out.text("Vorbis", "Vendor", clean(maker))
    for _ in range(min(number() or 0, MOST_TAGS)):
        line = text()
        if line is None:
            return
        key, equals, value = line.partition("=")
        if equals:
            out.text("Vorbis", VORBIS_NAMES.get(key.upper()) or tag_name(key.lower()), clean(value))


def _flac_stream(body: bytes, out: Tags) -> None:
    """Bits a sample, less one, are the five bits from bit 103 on of the stream's head."""
    if len(body) >= 18:
        out.push("FLAC", "BitsPerSample", (int.from_bytes(body[12:14], "big") >> 4 & 31) + 1)


FLAC_PARTS = {b"\x00": _flac_stream, b"\x04": vorbis}


def _behind_id3(d: bytes, magic: bytes, what: str, out: Tags) -> int:
    """Where a file begins behind the ID3 tag that it may have in front, whose tags come first."""
    at = id3_size(d)
    id3v2(d, out)
    if not d.startswith(magic, at):
        raise Invalid(f"not a {what} file")
    return at + len(magic)


def flac(d: bytes, out: Tags) -> None:
    _each(d, _behind_id3(d, b"fLaC", "FLAC", out), parts.flac_block, FLAC_PARTS, out)


def tta(d: bytes, out: Tags) -> None:
    _behind_id3(d, b"TTA1", "TTA", out)
    _tail(d, out)


def wavpack(d: bytes, out: Tags) -> None:
    """The RIFF head kept in the first block, the last RIFF trailer, and the tags behind the blocks."""
    blocks = [{kind: body for kind, body in parts.walk(block, 24, parts.wavpack_sub_block)} for _, block in _ends(d)]
    if not blocks:
        raise Invalid("not a WavPack file")
    head = blocks[0].get(RIFF_HEAD, b"")
    if head.startswith(b"RIFF"):
        _riff_parts(head[12:], out)
    _riff_parts(next((b[RIFF_TRAILER] for b in reversed(blocks) if RIFF_TRAILER in b), b""), out)
    _tail(d, out)


def _ends(d: bytes) -> list[tuple[bytes, bytes]]:
    """The first and the last block: others hold samples alone."""
    first = last = None
    for part in parts.walk(d, 0, parts.wavpack_block):
        first, last = first or part, part
    return [x for x in (first, last if last is not first else None) if x]


# --- MP4 --------------------------------------------------------------------------------------------------------------


class _Atoms:
    """Atoms below atoms, bounded in number and depth."""

    def __init__(self, out: Tags):
        self.out, self.left = out, MOST_ATOMS

    def each(self, d: bytes):
        for part in parts.walk(d, 0, parts.atom):
            if not self.left:
                return
            self.left -= 1
            yield part

    def read(self, d: bytes, path: tuple[bytes, ...] = ()) -> None:
        for kind, body in self.each(d):
            if kind in MP4_FOLDERS and len(path) < MOST_DEPTH:
                # a meta atom has four bytes of flags in front of its atoms, but some writers leave them out
                flags = 4 if kind == b"meta" and body[4:8] != b"hdlr" else 0
                self.read(body[flags:], (*path, kind))
            elif kind == b"ilst":
                for item, inner in self.each(body):
                    self.item(item, dict(self.each(inner)))
            elif kind == b"XMP_":
                xmp.read(body, self.out)
            elif kind == b"uuid" and body.startswith(XMP_UUID):
                xmp.read(body[len(XMP_UUID) :], self.out)
            elif path[-1:] == (b"udta",) and kind.startswith(b"\xa9"):
                self.user_text(kind, body)

    def user_text(self, kind: bytes, body: bytes) -> None:
        """A 16-bit length and a language in front of the text."""
        size = int.from_bytes(body[:2], "big")
        if kind in MP4_NAMES and 4 + size <= len(body):
            self.out.text("UserData", MP4_NAMES[kind], clean(body[4 : 4 + size].decode("utf-8", "replace")))

    def item(self, kind: bytes, inner: dict[bytes, bytes]) -> None:
        """An item's text, named by its own name atom if it has one."""
        named, data = inner.get(b"name", b""), inner.get(b"data", b"")
        name = tag_name(named[4:].decode("latin-1")) if len(named) >= 4 else MP4_NAMES.get(kind)
        code = MP4_TEXT.get(int.from_bytes(data[1:4], "big")) if len(data) >= 8 else None
        if name and code:
            self.out.text("ItemList", name, clean(data[8:].decode(code, "replace")))


def mp4(d: bytes, out: Tags) -> None:
    if d[4:8] != b"ftyp" or len(d) < 12:
        raise Invalid("not an MP4 file")
    _Atoms(out).read(d)

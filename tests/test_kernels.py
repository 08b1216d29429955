import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from mediamill import composers
from mediamill.errors import Invalid, Limit, MediaError, guarded
from mediamill.functions import encodings
from mediamill.kernels import audio, ccitt, ciphers, cmap, deflate, exif, icc, image, jbig2, jpeg, meta, morph, pdf, pdf_filters, pdf_render, pdf_write, png, postscript, qr, sanitize, skim, xmp
from mediamill.kernels.tags import Tags


def gray(w, h, v=200):
    return image.Image(w, h, "gray8", np.full((h, w), v, np.uint8))


def noise(fmt, w=13, h=9, seed=1):
    c = image.CHANNELS[fmt]
    return image.Image(w, h, fmt, np.random.default_rng(seed).integers(0, 256, (h, w * c), dtype=np.uint8))


# --- PNG ---------------------------------------------------------------------


@pytest.mark.parametrize("fmt", ["gray8", "gray_alpha8", "rgb8", "rgba8"])
def test_png_round_trip(fmt):
    img = noise(fmt)
    info, back = png.decode(png.encode(img))
    assert (info.width, info.height, back.format) == (13, 9, fmt)
    assert (back.data == img.data).all()


def test_png_rows_and_pieces():
    img = noise("rgb8", 300, 400)
    out = bytearray()
    w = png.RowWriter(out.extend, 300, 400, "rgb8")
    for at in range(0, 400, 33):
        w.write(img.data[at : at + 33])
    w.finish()
    assert bytes(out) == png.encode(img) and (png.decode(bytes(out))[1].data == img.data).all()
    one, four = png.encode_in_pieces(img, threads=1), png.encode_in_pieces(img, threads=4)
    assert one == four and (png.decode(four)[1].data == img.data).all()
    with pytest.raises(Invalid):
        png.RowWriter(out.extend, 300, 2, "rgb8").finish()


def _png(color, depth, w, h, raw, extra=(), interlace=0):
    head = png.chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, interlace))
    return b"".join([png.SIGNATURE, head, *(png.chunk(k, d) for k, d in extra), png.chunk(b"IDAT", zlib.compress(raw)), png.chunk(b"IEND", b"")])


def test_png_low_depths_palette_and_16_bits():
    _, a = png.decode(_png(0, 1, 8, 1, b"\0\xa5"))
    assert a.data.tolist() == [[255, 0, 255, 0, 0, 255, 0, 255]]
    _, a = png.decode(_png(0, 16, 2, 1, b"\0\x12\xff\xfe\x00"))
    assert a.data.tolist() == [[0x12, 0xFE]]
    _, a = png.decode(_png(3, 2, 4, 1, b"\0\x1b", [(b"PLTE", bytes([1, 2, 3, 4, 5, 6, 7, 8, 9]))]))
    assert a.samples().tolist() == [[[1, 2, 3], [4, 5, 6], [7, 8, 9], [0, 0, 0]]]
    _, a = png.decode(_png(3, 8, 1, 1, b"\0\0", [(b"PLTE", b"abc"), (b"tRNS", b"\x07")]))
    assert a.format == "rgba8" and a.data.tolist() == [[97, 98, 99, 7]]


def test_png_adam7():
    px = np.arange(64, dtype=np.uint8).reshape(8, 8)
    raw = b"".join(b"\0" + px[y, x::dx].tobytes() for x, y0, dx, dy in png.ADAM7 for y in range(y0, 8, dy))
    assert (png.decode(_png(0, 8, 8, 8, raw, interlace=1))[1].data == px).all()


def test_png_refusals():
    good = png.encode(gray(4, 4))
    with pytest.raises(Invalid):
        png.read_info(good[:-1])
    with pytest.raises(Invalid):
        png.read_info(good[:-1] + bytes([good[-1] ^ 1]))
    with pytest.raises(Invalid):
        png.read_info(_png(2, 4, 1, 1, b"\0\0"))
    with pytest.raises(Limit):
        png.decode(_png(0, 8, 65535, 65535, b"\0"))


def test_signature_rules():
    good = png.encode(image.Image(32, 10, "rgb8", np.full((10, 96), 255, np.uint8)))
    assert png.validate_signature(good)
    for bad, what in ((good + b"x", "trailing data"), (good[:-1] + b"\0", "CRC"), (png.encode(gray(4, 4), extra=[(b"tEXt", b"a\0b")]), "metadata"), (b"x" * 50, "invalid signature"), (png.encode(gray(2049, 1)), "dimensions")):
        with pytest.raises(Invalid, match=what):
            png.validate_signature(bad)


# --- JPEG --------------------------------------------------------------------


@pytest.mark.parametrize("sub", ["444", "422", "420"])
def test_jpeg_round_trip(sub):
    y, x = np.mgrid[0:45, 0:37]
    px = np.stack([x * 5 % 256, y * 4 % 256, (x + y) * 2 % 256], 2).astype(np.uint8)
    img = image.Image(37, 45, "rgb8", np.ascontiguousarray(px).reshape(45, -1))
    info, back = jpeg.decode(jpeg.encode(img, 95, sub))
    assert (back.width, back.height, back.format, info.transform) == (37, 45, "rgb8", "ycbcr")
    assert np.abs(back.data.astype(int) - img.data).mean() < 2


def test_jpeg_flat_gray_is_exact_and_truncation_is_an_error():
    data = jpeg.encode(gray(40, 24, 90), 100)
    assert (jpeg.decode(data)[1].data == 90).all()
    full = jpeg.encode(noise("rgb8", 256, 128), 90)
    assert sanitize.probe(full[: len(full) // 2])["width"] == 256
    with pytest.raises(Invalid):
        sanitize.verify(full[: len(full) // 2])


def test_jpeg_restart_markers():
    img = noise("gray8", 32, 16)
    data = jpeg.encode(img, 90)
    at = data.index(b"\xff\xda")
    with_interval = data[:at] + b"\xff\xdd\x00\x04\x00\x00" + data[at:]  # an interval of zero changes nothing
    assert (jpeg.decode(with_interval)[1].data == jpeg.decode(data)[1].data).all()


def test_progressive_scans_give_what_one_scan_does():
    rng = random.Random(11)
    for _ in range(25):
        blocks = [[rng.randint(-90, 90), *[rng.choice((0, 0, 0, 0, 1, -1, 2, -3, rng.randint(-40, 40))) if rng.random() < rng.choice((0.05, 0.6)) else 0 for _ in range(63)]] for _ in range(rng.randint(1, 9))]
        plain = jpeg.decode(composers.coefficient_jpeg(blocks, "baseline"))[1].data
        for how in ("restart", "progressive"):
            assert (jpeg.decode(composers.coefficient_jpeg(blocks, how))[1].data == plain).all()


def test_jpeg_tables():
    assert [len(jpeg.ac_values(k)) for k in (0, 1)] == [162, 162]
    assert jpeg.quant_table(jpeg.LUMA_QUANT, 50).tolist() == jpeg.LUMA_QUANT.tolist()
    assert jpeg.quant_table(jpeg.LUMA_QUANT, 100).max() == 1


def test_idct_of_dc_is_flat():
    b = np.zeros((1, 64), np.int32)
    b[0, 0] = 80
    assert (jpeg.idct(b) == 138).all()


# --- whole files --------------------------------------------------------------


def test_sanitize_removes_what_is_hidden():
    bad = png.encode(image.Image(32, 32, "rgb8", np.tile(np.uint8([255, 0, 0]), (32, 32))), extra=[(b"tEXt", b"Comment\0MALICIOUS_MARKER")]) + b"<html>"
    out = sanitize.sanitize(bad, "png")
    assert b"MALICIOUS" not in out and b"<html>" not in out
    assert (png.decode(out)[1].samples() == [255, 0, 0]).all()


def test_sanitize_refusals():
    with pytest.raises(Invalid):
        sanitize.sanitize(b"<html>", "png")
    with pytest.raises(Limit):
        sanitize.sanitize(png.encode(gray(8001, 1)), "png")
    animated = png.encode(gray(2, 2), extra=[(b"acTL", struct.pack(">II", 2, 0))])
    with pytest.raises(Invalid):
        sanitize.pixels(animated)


def test_orientations_are_permutations():
    img = noise("rgb8", 5, 3)
    px = img.samples()
    for o in range(1, 9):
        up = image.upright(img, o)
        assert (up.width, up.height) == ((3, 5) if o >= 5 else (5, 3))
        assert sorted(map(tuple, up.samples().reshape(-1, 3).tolist())) == sorted(map(tuple, px.reshape(-1, 3).tolist()))
    assert (image.upright(img, 6).samples()[0, -1] == px[0, 0]).all()
    assert (image.upright(img, 8).samples()[-1, 0] == px[0, 0]).all()


def test_exif_orientation_is_applied():
    tiff = b"II*\0\x08\0\0\0\x01\0" + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + bytes(4)
    assert exif.orientation(tiff) == 6
    data = png.encode(gray(5, 3), extra=[(b"eXIf", tiff)])
    out = sanitize.pixels(data)
    assert (out.width, out.height) == (3, 5)


def test_mutations_give_errors_of_their_own():
    rng = random.Random(7)
    bases = [png.encode(noise("rgb8", 24, 16)), jpeg.encode(noise("rgb8", 24, 16), 80)]
    for i in range(300):
        data = bytearray(bases[i % 2])
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        if i % 7 == 0:
            data = data[: rng.randrange(len(data))]
        r = guarded(sanitize.pixels, bytes(data))
        assert r["ok"] or r["error_class"] in ("Invalid", "Limit"), r


def test_div255_is_exact():
    v = np.arange(65026)
    assert (image.div255(v) == np.floor(v / 255 + 0.5)).all()


# --- metadata -----------------------------------------------------------------

PACKET = """<?xpacket begin=''?><x:xmpmeta xmlns:x='adobe:ns:meta/'><rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'>
<rdf:Description xmlns:xmp='http://ns.adobe.com/xap/1.0/' xmlns:dc='http://purl.org/dc/elements/1.1/' xmlns:tiff='http://ns.adobe.com/tiff/1.0/' xmp:CreatorTool='Tool &amp; Co' tiff:Orientation='6'>
<dc:description><rdf:Alt><rdf:li xml:lang='x-default'>hello</rdf:li><rdf:li xml:lang='ko-KR'>hi</rdf:li></rdf:Alt></dc:description>
<dc:subject><rdf:Bag><rdf:li>a</rdf:li><rdf:li>b</rdf:li></rdf:Bag></dc:subject></rdf:Description></rdf:RDF></x:xmpmeta>"""


def values(t):
    return {f"{x['tag_group']}:{x['name']}": x[x["kind"][0] if x["kind"] != "text" else "s"] if x["kind"] != "real" else x["r"] for x in t.tags}


def test_xmp_packet():
    t = Tags()
    xmp.read(PACKET.encode(), t)
    got = values(t)
    assert got["XMP-xmp:CreatorTool"] == "Tool & Co" and got["XMP-tiff:Orientation"] == "6"
    assert got["XMP-dc:Description"] == "hello" and got["XMP-dc:Description-ko-KR"] == "hi" and got["XMP-dc:Subject"] == ["a", "b"]


@pytest.mark.parametrize("bad", ["<!DOCTYPE x [<!ENTITY a 'b'>]><x>&a;</x>", "<a>" * 10_000, "<a><b></a>"])
def test_hostile_xml_gives_no_tags(bad):
    t = Tags()
    xmp.read(bad.encode(), t)
    assert not t.tags and t.warnings


def riff(*chunks):
    body = b"".join(k + struct.pack("<I", len(d)) + d + b"\0" * (len(d) & 1) for k, d in chunks)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def test_audio_containers(tmp_path):
    info = b"INFOISFT" + struct.pack("<I", 4) + b"Suno"
    wav = riff((b"fmt ", struct.pack("<HHIIHH", 1, 1, 8000, 8000, 2, 16)), (b"data", bytes(1 << 16)), (b"LIST", info))
    vendor, comment = b"lib", b"ENCODER=Lavf"
    block = struct.pack("<I", 3) + vendor + struct.pack("<II", 1, len(comment)) + comment
    flac = b"fLaC" + b"\x84" + len(block).to_bytes(3, "big") + block
    frame = b"TSSE" + struct.pack(">I", 5) + b"\0\0" + b"\0Lame"
    id3 = b"ID3\x03\0\0\0\0\0" + bytes([len(frame)]) + frame
    tta = id3 + b"TTA1" + bytes(40) + b"TAG" + b"Song".ljust(30, b"\0") + bytes(95)
    atom = lambda k, d: struct.pack(">I", len(d) + 8) + k + d
    mp4 = atom(b"ftyp", b"M4A \0\0\0\0") + atom(b"mdat", bytes(999)) + atom(b"moov", atom(b"udta", atom(b"meta", bytes(4) + atom(b"ilst", atom(b"\xa9too", atom(b"data", struct.pack(">II", 1, 0) + b"Lavf"))))))
    cases = {"wav": (wav, "RIFF:Software", "Suno"), "flac": (flac, "Vorbis:Encoder", "Lavf"), "tta": (tta, "ID3v2_3:Encoder", "Lame"), "mp4": (mp4, "ItemList:Encoder", "Lavf")}
    for kind, (data, key, want) in cases.items():
        assert meta.detect(data) == kind
        whole = meta.read(data)
        assert values(whole)[key] == want
        path = tmp_path / kind
        path.write_bytes(data)
        with path.open("rb") as f:
            assert skim.read(f).tags == whole.tags  # reading by parts gives the same


def test_syncsafe():
    assert audio.syncsafe(bytes([0, 0, 2, 1])) == 257 and audio.syncsafe(b"\x80\0\0\0") is None


def test_png_metadata_ignores_checksums():
    data = bytearray(png.encode(gray(1, 1), extra=[(b"tEXt", b"prompt\0a cat")]))
    data[data.index(b"a cat") + 5] ^= 1  # the text's checksum
    assert values(meta.read(bytes(data)))["PNG:Prompt"] == "a cat"
    with pytest.raises(Invalid):
        sanitize.probe(bytes(data))


# --- ICC, QR, PDF, streams ------------------------------------------------------


def test_icc_srgb_like_profile_changes_little():
    p = icc.matrix_profile("test", icc.SRGB, 2.2)
    got = icc.Profile(p)
    assert got.description == "test" and got.space == b"RGB " and not got.is_v4
    px = np.array([[0, 0, 0], [255, 255, 255], [128, 64, 200]], np.uint8)
    out = icc.to_srgb(p, 3).convert(px)
    assert out[0].tolist() == [0, 0, 0] and out[1].tolist() == [255, 255, 255] and np.abs(out[2].astype(int) - px[2]).max() <= 6


def test_icc_tetrahedral_is_exact_on_a_linear_grid():
    axes = np.stack(np.meshgrid(*[np.linspace(0, 1, 5)] * 3, indexing="ij"), axis=-1)
    x = np.random.default_rng(3).random((50, 3))
    assert np.allclose(icc.interpolate(axes, x), x)


@pytest.mark.parametrize(("version", "level"), [(1, 0), (2, 1), (7, 2), (12, 3)])
def test_qr_symbols_are_found_turned_and_mirrored(version, level):
    grid = qr.encode(b"abc", level, version % 8, version)
    px = qr.picture(grid, 3)
    assert qr.scan(px)["decoded"] == qr.scan(np.rot90(px))["decoded"] == qr.scan(px[:, ::-1])["decoded"] == 1


@pytest.mark.parametrize("version", [3, 6, 10])
def test_qr_symbols_in_perspective(version):
    grid = qr.encode(b"seen from the side", 1, 2, version)
    px = qr.picture(grid, 6)
    side = px.shape[0]
    corners = np.array([[0, 0], [side, 0], [0, side], [side, side]], dtype=float)
    seen = np.array([[0, 0], [side * 0.95, side * 0.03], [side * 0.04, side * 0.94], [side * 0.9, side * 0.91]])
    back = np.linalg.inv(qr._homography(corners, seen))
    y, x = np.mgrid[0:side, 0:side]
    p = np.floor(qr._map(back, np.column_stack([x.ravel() + 0.5, y.ravel() + 0.5]))).astype(int)
    ok = (p >= 0).all(axis=1) & (p < side).all(axis=1)
    turned = np.full(side * side, 255, np.uint8)
    turned[ok] = px[p[ok, 1], p[ok, 0]]
    assert qr.scan(turned.reshape(side, side))["decoded"] == 1


def test_qr_counts_and_mends():
    one = qr.picture(qr.encode(b"hello", 3), 4)
    assert qr.scan(np.hstack([one, one]))["decoded"] == 2
    assert qr.scan(np.full((80, 80), 255, np.uint8)) == {"candidates": 0, "decoded": 0}
    grid = qr.encode(b"hello", 3)
    grid[10, 10:13] ^= True
    assert qr.decode_grid(grid)
    block = list(range(20)) + qr.rs_encode(list(range(20)), 10)
    block[3] ^= 5
    block[25] ^= 77
    assert qr.rs_correct(block, 10) and block[:20] == list(range(20))


def test_pdf_write_read_and_repair():
    part = jpeg.encode(gray(16, 8), 85)
    data = pdf_write.image_pdf([(16, 8, part)] * 3)
    doc = pdf.Document(data)
    assert pdf.inspect(data) == {"pages": 3, "encrypted": False} and not doc.repaired
    assert doc.size(doc.pages()[0]) == (792.0, 396.0)
    assert [op for op, _ in pdf.operators(doc.content(doc.pages()[0]))] == ["q", "cm", "Do", "Q"]
    broken = data.replace(b"startxref", b"startxxxx")
    assert pdf.inspect(broken) == {"pages": 3, "encrypted": False} and pdf.Document(broken).repaired
    with pytest.raises(Invalid):
        pdf.Document(b"junk")


def test_pdf_object_and_xref_streams():
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 100 50] /Rotate 90 >>"}
    head, body = b"", b""
    for n, o in objects.items():
        head += b"%d %d " % (n, len(body))
        body += o + b" "
    packed = zlib.compress(head + body)
    out = b"%PDF-1.5\n"
    at4 = len(out)
    out += b"4 0 obj\n<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(head), len(packed)) + packed + b"\nendstream\nendobj\n"
    at5 = len(out)
    rows = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0)]
    table = zlib.compress(b"".join(struct.pack(">BHB", *r) for r in rows))
    out += b"5 0 obj\n<< /Type /XRef /Size 6 /W [1 2 1] /Root 1 0 R /Filter /FlateDecode /Length %d >>\nstream\n" % len(table) + table + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % at5
    doc = pdf.Document(out)
    assert not doc.repaired and [doc.size(p) for p in doc.pages()] == [(50.0, 100.0)]


def test_filters():
    assert pdf_filters.ascii_hex(b"61 62 7>") == b"abp"
    assert pdf_filters.ascii_85(b"87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert pdf_filters.run_length(bytes([2]) + b"abc" + bytes([254]) + b"z\x80") == b"abczzz"
    assert pdf_filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    rows = np.arange(12, dtype=np.uint8).reshape(3, 4)
    up = np.vstack([rows[:1], rows[1:] - rows[:-1]])
    raw = b"".join(b"\2" + r.tobytes() for r in up)
    assert pdf_filters.apply("FlateDecode", zlib.compress(raw), {"Predictor": 12, "Columns": 4}) == rows.tobytes()
    sub = np.diff(rows, axis=1, prepend=0).astype(np.uint8)
    assert pdf_filters.predict(sub.tobytes(), {"Predictor": 2, "Columns": 4}) == rows.tobytes()
    assert pdf_filters.flate(zlib.compress(b"a" * 500)[:-4]) == b"a" * 500


def test_fax_white_and_runs():
    # two-dimensional: a white row is one vertical mode
    assert ccitt.decode(bytes([0b11000000]), -1, 8, 2) == b"\xff\xff"
    # one-dimensional: 2 white, 3 black, 3 white
    bits = "0111" + "10" + "1000"
    assert ccitt.decode(int(bits.ljust(16, "0"), 2).to_bytes(2, "big"), 0, 8, 1) == bytes([0b11000111])


class _Coder:
    """The arithmetic encoder of the standard, for round trips."""

    def __init__(self):
        self.a, self.c, self.ct, self.out = 0x8000, 0, 12, bytearray([0])

    def bit(self, contexts, cx, b):
        state, mps = contexts[cx] >> 1, contexts[cx] & 1
        q, after, less, change = jbig2._STATES[state]
        self.a -= q
        if b == mps:
            if self.a & 0x8000:
                self.c += q
                return
            if self.a < q:
                self.a = q
            else:
                self.c += q
            contexts[cx] = after << 1 | mps
        else:
            if self.a < q:
                self.c += q
            else:
                self.a = q
            contexts[cx] = less << 1 | (mps ^ change)
        while True:
            self.a, self.c, self.ct = self.a << 1, self.c << 1, self.ct - 1
            if not self.ct:
                self._byte()
            if self.a & 0x8000:
                return

    def _byte(self):
        if self.out[-1] != 0xFF and self.c & 0x8000000:
            self.out[-1] += 1
            self.c &= 0x7FFFFFF
        if self.out[-1] == 0xFF:
            self.out.append(self.c >> 20 & 0xFF)
            self.c, self.ct = self.c & 0xFFFFF, 7
        else:
            self.out.append(self.c >> 19 & 0xFF)
            self.c, self.ct = self.c & 0x7FFFF, 8

    def done(self):
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.ct
            self._byte()
        return bytes(self.out[1:]) + b"\xff\xac"

    def integer(self, contexts, v):
        prev = 1

        def put(b):
            nonlocal prev
            self.bit(contexts, prev, b)
            prev = prev << 1 | b if prev < 256 else ((prev << 1 | b) & 511) | 256

        put(int(v is None or v < 0))
        v = 0 if v is None else abs(v)
        k = max(i for i, (_, o) in enumerate(jbig2._INTEGERS) if v >= o)
        for _ in range(k):
            put(1)
        if k < 5:
            put(0)
        n, o = jbig2._INTEGERS[k]
        for i in range(n - 1, -1, -1):
            put(v - o >> i & 1)


def _encode_bits(coder, contexts, px, template, adaptive):
    places = [adaptive[int(p[1])] if isinstance(p, str) else p for p in jbig2._TEMPLATES[template]]
    at = lambda x, y: bool(px[y, x]) if 0 <= x < px.shape[1] and 0 <= y else False
    for y in range(px.shape[0]):
        for x in range(px.shape[1]):
            coder.bit(contexts, sum(at(x + dx, y + dy) << k for k, (dx, dy) in enumerate(places)), int(px[y, x]))


_AT = {0: [(3, -1), (-3, -1), (2, -2), (-2, -2)], 1: [(3, -1)], 2: [(2, -1)], 3: [(2, -1)]}


def _segment(number, kind, body, refs=()):
    return struct.pack(">IBB", number, kind, len(refs) << 5) + bytes(refs) + b"\1" + struct.pack(">I", len(body)) + body


def test_arithmetic_decoder_on_the_sequence_of_the_standard():
    coded = bytes.fromhex("84C73BFCE1A1430402200000410DBB86F4317FFF88FF37471ADB6ADFFFAC")
    plain = bytes.fromhex("00020051000000C0035287 2AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF".replace(" ", ""))
    d, cx = jbig2.Decoder(coded), bytearray(1)
    assert int("".join(str(d.bit(cx, 0)) for _ in range(256)), 2).to_bytes(32, "big") == plain


@pytest.mark.parametrize("template", [0, 1, 2, 3])
def test_bilevel_generic_regions(template):
    px = np.random.default_rng(template).random((19, 33)) < 0.3
    px[5:9] = True
    coder = _Coder()
    _encode_bits(coder, bytearray(1 << 16), px, template, _AT[template])
    at = b"".join(struct.pack(">bb", *a) for a in _AT[template])
    region = struct.pack(">IIIIB", 33, 19, 2, 1, 0) + bytes([template << 1]) + at + coder.done()
    data = _segment(0, 48, struct.pack(">IIIIBH", 40, 21, 0, 0, 0, 0)) + _segment(1, 38, region)
    got = jbig2.decode(data)
    assert got.shape == (21, 40) and (got[1:20, 2:35] == px).all() and got.sum() == px.sum()
    assert len(pdf_filters.apply("JBIG2Decode", data, {})) == 21 * 5


def test_bilevel_symbols_and_text():
    shapes = [np.array([[1, 0, 1], [1, 1, 1]], bool), np.array([[0, 1], [1, 0]], bool)]
    coder, heights, widths, exports, pixels = _Coder(), bytearray(512), bytearray(512), bytearray(512), bytearray(1 << 16)
    coder.integer(heights, 2)
    for step, s in ((3, shapes[0]), (-1, shapes[1])):
        coder.integer(widths, step)
        _encode_bits(coder, pixels, s, 0, _AT[0])
    coder.integer(widths, None)
    coder.integer(exports, 0)
    coder.integer(exports, 2)
    at = b"".join(struct.pack(">bb", *a) for a in _AT[0])
    symbols = struct.pack(">H", 0) + at + struct.pack(">II", 2, 2) + coder.done()
    coder = _Coder()
    t, first, step, names = bytearray(512), bytearray(512), bytearray(512), bytearray(4)
    coder.integer(t, 0)
    coder.integer(t, 4)
    coder.integer(first, 1)
    coder.bit(names, 1, 0)
    coder.integer(step, 2)
    coder.bit(names, 1, 1)
    coder.integer(step, None)
    text = struct.pack(">IIIIB", 12, 8, 0, 0, 0) + struct.pack(">HI", 1 << 4, 2) + coder.done()
    page = struct.pack(">IIIIBH", 12, 8, 0, 0, 0, 0)
    got = jbig2.decode(_segment(1, 48, page) + _segment(2, 6, text, [0]), _segment(0, 0, symbols))
    want = np.zeros((8, 12), bool)
    want[4:6, 1:4], want[4:6, 5:7] = shapes
    assert (got == want).all()
    with pytest.raises(Invalid):
        jbig2.decode(b"junk" * 9)


def test_ciphers():
    assert ciphers._encrypt(bytes.fromhex("00112233445566778899aabbccddeeff"), ciphers._schedule(bytes(range(16)))).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert ciphers.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    sealed = ciphers.aes_cbc_encrypt(b"k" * 32, b"x" * 10 + bytes([6]) * 6, b"i" * 16)
    assert ciphers.aes_cbc(b"k" * 32, b"i" * 16 + sealed) == b"x" * 10


def test_encrypted_document_with_an_empty_password():
    owner, ident = b"o" * 32, b"idididididididid"
    e = {"O": owner, "P": -4, "R": 3}
    key = hashlib.md5(pdf.PADDING + owner + struct.pack("<i", -4) + ident).digest()
    for _ in range(50):
        key = hashlib.md5(key[:16]).digest()
    u = hashlib.md5(pdf.PADDING + ident).digest()
    for i in range(20):
        u = ciphers.rc4(bytes(b ^ i for b in key), u)
    e["U"] = u + bytes(16)
    assert pdf.file_key_old(b"", e, 3, 16, ident) == key
    assert pdf.file_key_old(b"wrong", e, 3, 16, ident) is None


def test_postscript_calculator():
    run = lambda code, *x: postscript.run(postscript.tokens(code), list(x))
    assert run(b"{ dup mul exch 2 copy add 3 1 roll pop pop }", 3, 4) == [19.0]
    assert run(b"{ 0.5 gt { 1 } { 0 } ifelse }", 0.7) == [1.0]
    assert run(b"{ 90 sin 2.5 round -2.5 round 7 2 idiv 1 0 atan }") == [1.0, 3.0, -3.0, 3.0, 90.0]
    with pytest.raises(Invalid):
        run(b"{ pop pop }", 1)


def test_sampled_function():
    d = {"Size": [2], "BitsPerSample": 8}
    assert postscript.sampled(bytes([0, 255]), d, [0.25], [(0, 1)], [(0, 1)]) == [pytest.approx(0.25)]


def _page(content, resources=b"<< >>", extra=b"", size=(100, 50)):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 100 50] /Contents 4 0 R /Resources " + resources + extra + b" >>", b"<< /Length %d >>\nstream\n" % len(content) + content + b"\nendstream"]
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % i + o + b"\nendobj\n" for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>"
    doc = pdf.Document(data)
    return pdf_render.render(doc, doc.pages()[0], size=size).samples()


def test_pages_are_painted():
    px = _page(b"1 0 0 rg 10 10 20 20 re f")
    assert px[25, 20].tolist() == [255, 0, 0] and px[25, 40].tolist() == [255] * 3 and (px[20:40, 10:30] == [255, 0, 0]).all()
    px = _page(b"0 0 1 RG 4 w 10 25 m 90 25 l S")
    assert px[25, 50].tolist() == [0, 0, 255] and px[21, 50].tolist() == [255] * 3
    px = _page(b"q 0 0 50 50 re W n 0 g 0 0 100 50 re f Q")
    assert px[25, 25].sum() == 0 and px[25, 75].sum() == 765
    px = _page(b"0 g 0 0 100 50 re 20 10 60 30 re f*")
    assert px[25, 50].sum() == 765 and px[2, 2].sum() == 0
    px = _page(b"/G gs 0 g 0 0 100 50 re f", b"<< /ExtGState << /G << /ca 0.5 >> >> >>")
    assert px[10, 10].tolist() == [128] * 3
    px = _page(b"1 0 0 rg 0 0 50 50 re f", extra=b" /Rotate 90", size=(50, 100))
    assert px[10, 25].tolist() == [255, 0, 0] and px[90, 25].tolist() == [255] * 3
    px = _page(b"/S sh", b"<< /Shading << /S << /ShadingType 2 /ColorSpace /DeviceGray /Coords [0 0 100 0] /Function << /FunctionType 2 /Domain [0 1] /C0 [0] /C1 [1] /N 1 >> >> >> >>")
    assert px[25, 0, 0] < 5 and abs(int(px[25, 50, 0]) - 128) < 4 and px[25, 99, 0] > 250
    px = _page(b"q 100 0 0 50 0 0 cm BI /W 2 /H 1 /BPC 8 /CS /G ID \x00\xff EI Q")
    assert px[25, 10, 0] == 0 and px[25, 90, 0] == 255
    assert pdf_render.render_size(612, 792) == (1583, 2048) and pdf_render.render_size(842, 595) == (2048, 1448) and pdf_render.render_size(10000, 1) == (2048, 1)


def test_patterns_and_function_shadings():
    ramp = b"<< /FunctionType 2 /Domain [0 1] /C0 [0] /C1 [1] /N 1 >>"
    shade = b"<< /PatternType 2 /Shading << /ShadingType 2 /ColorSpace /DeviceGray /Coords [0 0 100 0] /Function " + ramp + b" >> >>"
    px = _page(b"/Pattern cs /P scn 0 0 50 50 re f", b"<< /Pattern << /P " + shade + b" >> >>")
    assert abs(int(px[25, 40, 0]) - 103) < 5 and px[25, 75].sum() == 765
    tile = b"<< /PatternType 1 /PaintType 1 /TilingType 1 /BBox [0 0 10 10] /XStep 10 /YStep 10 /Resources << >> /Length 27 >>\nstream\n1 0 0 rg 0 0 5 10 re f     \nendstream"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 100 50] /Contents 4 0 R /Resources << /Pattern << /T 5 0 R >> >> >>", b"<< /Length 35 >>\nstream\n/Pattern cs /T scn 0 0 100 50 re f  \nendstream", tile]
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % i + o + b"\nendobj\n" for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>"
    doc = pdf.Document(data)
    px = pdf_render.render(doc, doc.pages()[0], size=(100, 50)).samples()
    assert px[20, 2].tolist() == px[20, 92].tolist() == [255, 0, 0] and px[20, 7].tolist() == [255] * 3


def test_blend_modes_keep_to_the_range():
    b, s = np.random.default_rng(4).random((2, 200, 3))
    for mode in "Normal Multiply Screen Overlay Darken Lighten ColorDodge ColorBurn HardLight SoftLight Difference Exclusion Hue Saturation Color Luminosity".split():
        out = pdf_render.blend(mode, b, s)
        assert out.min() >= -1e-6 and out.max() <= 1 + 1e-6
    assert np.allclose(pdf_render.blend("Luminosity", b, b), b) and np.allclose(pdf_render.blend("Multiply", b, s), b * s)


def test_character_maps():
    m = cmap.parse(b"/CMapName /Own def /WMode 1 def 1 begincodespacerange <00> <7f> <8140> <9ffc> endcodespacerange 1 begincidrange <20> <7e> 1 endcidrange 1 begincidchar <8141> 900 endcidchar 2 beginbfchar <21> <0041> <22> <00660069> endbfchar 1 beginbfrange <30> <32> <0061> endbfrange")
    assert (m.name, m.vertical) == ("Own", True) and m.cid(0x22, 1) == 3 and m.cid(0x8141, 2) == 900 and m.cid(0x22, 2) is None
    assert m.text(0x21, 1) == "A" and m.text(0x22, 1) == "fi" and m.text(0x32, 1) == "c"
    assert m.split(b"\x21\x81\x41\xff") == [(0x21, 1), (0x8141, 2), (0xFF, 1)]
    over = cmap.parse(b"/Own usecmap 1 begincidchar <21> 77 endcidchar", {"Own": m})
    assert over.cid(0x21, 1) == 77 and over.cid(0x22, 1) == 3
    assert cmap.parse(b"/Identity-H usecmap").cid(0x1234, 2) == 0x1234
    with pytest.raises(Invalid):
        cmap.parse(b"/Missing usecmap")


def test_glyph_names():
    standard, win, mac = (encodings.table(n) for n in ("Standard", "WinAnsi", "MacRoman"))
    assert (standard[0x41], standard[39], standard[96], standard[0x30], standard[0xAE], standard[0xFB], standard[0xE8]) == ("A", "quoteright", "quoteleft", "zero", "fi", "germandbls", "Lslash")
    assert (win[39], win[0x80], win[0xE9], win[0xC7], win[0x8A], win[0xF8], win[0x7F]) == ("quotesingle", "Euro", "eacute", "Ccedilla", "Scaron", "oslash", "bullet")
    assert (mac[0x80], mac[0xCA], mac[0xDE], mac[0xB9]) == ("Adieresis", "space", "fi", "pi") and 0xA0 not in standard


def test_document_budget_and_hostile_parts():
    part = jpeg.encode(gray(16, 8), 85)
    assert pdf.inspect(pdf_render.sanitize(pdf_write.image_pdf([(16, 8, part)])))["pages"] == 1
    with pytest.raises(Limit):
        pdf_render.checked(pdf_write.image_pdf([(16, 8, part)] * 32))
    with pytest.raises(Invalid):
        pdf_render.checked(pdf_write.image_pdf([(16, 8, part)] * 33))
    hostile = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R /OpenAction << /S /JavaScript /JS (app.alert) >> >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R 2 0 R] /Count 1 >>\nendobj\n3 0 obj\n<< /Type /Page /MediaBox [0 0 100 100] >>\nendobj\ntrailer << /Root 1 0 R >>"
    assert b"JavaScript" not in pdf_render.sanitize(hostile)


def test_deflate_limits():
    z = zlib.compress(b"a" * 1000)
    assert deflate.inflate(z + b"tail", 1000) == (b"a" * 1000, len(z), True)
    with pytest.raises(Limit):
        deflate.inflate(z, 999)
    with pytest.raises(Invalid):
        deflate.inflate_exact(z + b"x", 1000)
    data = bytes(np.random.default_rng(0).integers(0, 4, 90_000, dtype=np.uint8))
    assert zlib.decompress(deflate.compress_pieces(data, 30_000)) == data


def test_morphology():
    a = np.zeros((9, 9), bool)
    a[3:6, 3:6] = True
    assert morph.dilate(a, 3, 3).sum() == 25 and morph.erode(a, 3, 3).sum() == 1
    assert (morph.opened(a, 3, 3) == a).all() and (morph.closed(a, 3, 3) == a).all()
    b = a.copy()
    b[0, 0] = True
    assert morph.components(b)[1] == 2 and morph.boxes(b) == [(0, 0, 1, 1), (3, 3, 3, 3)]
    d = np.eye(4, dtype=bool)
    assert morph.components(d, 4)[1] == 4 and morph.components(d, 8)[1] == 1
    assert morph.distance(a)[4, 4] == 2 and len(morph.outlines(b)) == 2
    assert (morph.seed_fill(np.pad(np.ones((1, 1), bool), ((4, 4), (4, 4))), b) == a).all()


def test_otsu_separates_two_levels():
    t, total, below = morph.otsu(np.bincount([10] * 30 + [200] * 70, minlength=256))
    assert (t, total, below) == (10, 100, 30)
    page = np.full((20, 20), 250, np.uint8)
    page[5:8, 5:8] = 10
    assert morph.binarise([page]).sum() == 9


def test_guard_never_lets_an_error_out():
    def broken(_):
        raise KeyError("x")

    assert guarded(broken, b"")["error_class"] == "Internal"
    assert issubclass(Limit, MediaError)

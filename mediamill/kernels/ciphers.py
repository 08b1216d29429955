"""RC4 and AES (FIPS 197) in plain Python, for documents that ask for them."""

from __future__ import annotations


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = b ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = (a << 1) ^ (0x11B if a & 128 else 0), b >> 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    """The substitution box: inverses in GF(256) under an affine map."""
    box = [0] * 256
    for v in range(256):
        inv = next((x for x in range(256) if _times(v, x) == 1), 0)
        out = 0x63
        for k in range(5):
            out ^= (inv << k | inv >> (8 - k)) & 255
        box[v] = out
    back = [0] * 256
    for i, v in enumerate(box):
        back[v] = i
    return box, back


_BOX, _BACK = _boxes()
_MUL = {k: [_times(v, k) for v in range(256)] for k in (2, 3, 9, 11, 13, 14)}


def _schedule(key: bytes) -> list[list[int]]:
    n = len(key) // 4
    words = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
    con = 1
    for i in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if i % n == 0:
            w = [_BOX[b] for b in w[1:] + w[:1]]
            w[0] ^= con
            con = _times(con, 2)
        elif n > 6 and i % n == 4:
            w = [_BOX[b] for b in w]
        words.append([a ^ b for a, b in zip(words[i - n], w, strict=True)])
    return [sum(words[4 * r : 4 * r + 4], []) for r in range(n + 7)]


def _decrypt(block: bytes, keys: list[list[int]]) -> bytes:
    s = [a ^ b for a, b in zip(block, keys[-1], strict=True)]
    m9, m11, m13, m14 = _MUL[9], _MUL[11], _MUL[13], _MUL[14]
    for r in range(len(keys) - 2, -1, -1):
        s = [_BACK[s[(i - 4 * (i % 4)) % 16]] ^ keys[r][i] for i in range(16)]
        if r:
            t = []
            for c in range(0, 16, 4):
                a, b, d, e = s[c : c + 4]
                t += [m14[a] ^ m11[b] ^ m13[d] ^ m9[e], m9[a] ^ m14[b] ^ m11[d] ^ m13[e], m13[a] ^ m9[b] ^ m14[d] ^ m11[e], m11[a] ^ m13[b] ^ m9[d] ^ m14[e]]
            s = t
    return bytes(s)


def _encrypt(block: bytes, keys: list[list[int]]) -> bytes:
    s = [a ^ b for a, b in zip(block, keys[0], strict=True)]
    m2, m3 = _MUL[2], _MUL[3]
    for r in range(1, len(keys)):
        s = [_BOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
        if r < len(keys) - 1:
            t = []
            for c in range(0, 16, 4):
                a, b, d, e = s[c : c + 4]
                t += [m2[a] ^ m3[b] ^ d ^ e, a ^ m2[b] ^ m3[d] ^ e, a ^ b ^ m2[d] ^ m3[e], m3[a] ^ b ^ d ^ m2[e]]
            s = t
        s = [a ^ b for a, b in zip(s, keys[r], strict=True)]
    return bytes(s)


def aes_cbc(key: bytes, data: bytes, iv: bytes | None = None, padded: bool = True) -> bytes:
    """Decrypt; without ``iv`` it is the data's first block.  Padding that isn't right is left on."""
    if iv is None:
        iv, data = data[:16], data[16:]
    keys, out = _schedule(key), bytearray()
    for i in range(0, len(data) // 16 * 16, 16):
        block = data[i : i + 16]
        out += bytes(a ^ b for a, b in zip(_decrypt(block, keys), iv, strict=True))
        iv = block
    if padded and out and 1 <= out[-1] <= 16:
        del out[-out[-1] :]
    return bytes(out)


def aes_cbc_encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    keys, out = _schedule(key), bytearray()
    for i in range(0, len(data), 16):
        iv = _encrypt(bytes(a ^ b for a, b in zip(data[i : i + 16], iv, strict=True)), keys)
        out += iv
    return bytes(out)

"""Exact encoding with a word-level BPE file of the ``tokenizers`` library, by pieces between white space.

The file's normaliser (NFC, white space to one space, lower case) and its pre-tokeniser
(a split pattern that never matches white space) act on each run of characters between
white space by itself, so a text's ids are those of its runs, one after the other, and a
run is encoded once a batch at most.  :func:`supported` checks that a file is of this
kind.  Texts with special-token strings, or with characters on which Python's rules and
the library's differ, go through the library as a whole.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from .textkit import U64, slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Python splits at these four controls and the library doesn't; both treat a capital sigma by different rules.
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "Σ")
CACHE = 300_000

# The split pattern and the byte-to-character table that the file's pre-tokeniser names.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible, else one from 256 up."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


def supported(spec: dict) -> bool:
    norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = spec["model"]
    return (
        norm == ["NFC", "Replace", "Lowercase"]
        and [x.get("type") for x in pre] == ["Split", "ByteLevel"]
        and pre[0].get("pattern") == {"Regex": PATTERN}
        and not pre[1].get("add_prefix_space")
        and model.get("type") == "BPE"
        and not model.get("continuing_subword_prefix")
        and not model.get("ignore_merges")
        and model.get("dropout") is None
    )


def odd(text: str) -> bool:
    return any([x in text for x in _ODD])


class Merger:
    """The file's merges, applied to many words at once.

    Words are rows of symbol ids; in each round every row merges the leftmost of its
    lowest-ranked pairs, which is the order of the reference algorithm, until no row has a
    pair with a rank.
    """

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        chars = byte_characters()
        self.plain = np.array([vocab.get(c, -1) for c in chars], dtype=np.int64)
        self.final = np.array([vocab.get(c + self.suffix, -1) for c in chars], dtype=np.int64)
        self.whole = bool((self.plain >= 0).all() and (self.final >= 0).all())
        left, right, made = [], [], []
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(vocab[a + b])
        self.width = max(vocab.values()) + 1
        key = np.array(left, dtype=np.int64) * self.width + np.array(right, dtype=np.int64)
        rank = np.arange(len(key), dtype=np.int64)
        key, pick = np.unique(key, return_index=True)
        self._table(key, rank[pick], np.array(made, dtype=np.int64)[pick])

    def _table(self, key: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        """An open-addressing hash table: slots are filled in rounds, each key at the first free slot after its own."""
        bits = max(4, int(len(key) * 4).bit_length())
        self.shift, size = 64 - bits, 1 << bits
        self.keys = np.full(size + 64, -1, dtype=np.int64)
        self.value = np.zeros(size + 64, dtype=np.int64)
        at = self._slot(key)
        left = np.arange(len(key))
        self.probes = 0
        while len(left):
            free = self.keys[at[left]] < 0
            slots, which = np.unique(at[left[free]], return_index=True)
            placed = left[free][which]
            self.keys[slots] = key[placed]
            self.value[slots] = placed
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] += 1
            self.probes += 1
        self.rank, self.made = np.append(rank, np.int64(1) << 40), np.append(made, -1)
        self.none = len(key)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(self.shift)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Index of each pair in the merge table, or ``none``."""
        out = np.full(len(key), self.none, dtype=np.int64)
        at = self._slot(key)
        todo = np.arange(len(key))
        for _ in range(self.probes + 1):
            got = self.keys[at]
            hit = got == key[todo]
            out[todo[hit]] = self.value[at[hit]]
            more = ~hit & (got >= 0)
            todo, at = todo[more], at[more] + 1
            if not len(todo):
                break
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        lo = 0
        while lo < len(words):
            hi, held = lo, 0
            while hi < len(words) and (hi == lo or held + len(words[hi]) <= 1 << 18):
                held += len(words[hi])
                hi += 1
            out += self._block(words[lo:hi])
            lo = hi
        return out

    def _block(self, words: list[bytes]) -> list[bytes]:
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        start = np.cumsum(size) - size
        real = size > 0
        ids = self.plain[raw]
        last = (start + size - 1)[real]
        ids[last] = self.final[raw[last]]
        done_ids: list[np.ndarray] = []
        done_row: list[np.ndarray] = []
        row, start, size = np.flatnonzero(real), start[real], size[real]
        pair = np.full(len(ids), self.none, dtype=np.int64)
        inner = np.ones(len(ids), dtype=bool)
        inner[last] = False
        at = np.flatnonzero(inner)
        pair[at] = self.find(ids[at] * self.width + ids[at + 1])
        top = np.int64(1) << 40
        while len(row):
            key = (self.rank[pair] << np.int64(22)) | np.arange(len(pair))
            best = np.minimum.reduceat(key, start)
            live = (best >> np.int64(22)) < top
            if not live.all():
                gone = np.repeat(~live, size)
                done_ids.append(ids[gone])
                done_row.append(np.repeat(row[~live], size[~live]))
                stay = ~gone
                shift = np.cumsum(gone)
                at = (best[live] & np.int64((1 << 22) - 1)).astype(np.int64)
                at -= shift[at]
                ids, pair = ids[stay], pair[stay]
                row, size = row[live], size[live]
                if not len(row):
                    break
            else:
                at = (best & np.int64((1 << 22) - 1)).astype(np.int64)
            ids[at] = self.made[pair[at]]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids, pair = ids[keep], pair[keep]
            at -= np.arange(len(at))
            size = size - 1
            start = np.cumsum(size) - size
            pair[at] = self.none
            right = at[at + 1 < start + size]
            left = at[at > start] - 1
            new = np.concatenate([left, right])
            pair[new] = self.find(ids[new] * self.width + ids[new + 1])
        flat, owner = np.concatenate(done_ids or [ids]), np.concatenate(done_row or [row])
        order = np.argsort(owner, kind="stable")
        body = flat[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(owner, minlength=len(words))) * 4).tolist()
        return [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class ChunkEncoder:
    """Ids of texts by their runs between white space, with a bounded cache of runs in two halves.

    A full half becomes the older one and what it is asked for again moves to the new one, so
    runs that come often stay.

    ``pieces`` gives the ids of lower-cased, split pieces (pre-tokens) that no cache holds:
    merged exactly and all at once.  A file of another kind goes through the library.
    """

    def __init__(self, path: str, cache: int = CACHE):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = supported(spec)
        self.spec = spec
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self.fast and all("<|" in t for t in self.specials)
        self.merger = Merger(spec) if self.fast else None
        self.fast = self.fast and self.merger.whole
        self.find = regex.compile(PATTERN).findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = cache

    def pieces(self, words: list[str]) -> list[bytes]:
        return self.merger.encode([w.encode() for w in words])

    def by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null is an empty text."""
        out: list[bytes] = [b""] * len(texts)
        rows: list[tuple[int, int]] = []
        every: list[str] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.fast or odd(text):
                out[i] = self.by_library(text)
                continue
            every += (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split()
            rows.append((i, len(every)))
        cache = self.cache
        missing = set(every).difference(cache)
        if missing and self.older:
            again = {r: self.older[r] for r in missing if r in self.older}
            cache.update(again)
            missing.difference_update(again)
        if missing:
            self._fill(missing)
        ids = list(map(cache.__getitem__, every))
        lo = 0
        for i, hi in rows:
            out[i] = b"".join(ids[lo:hi])
            lo = hi
        if len(cache) > self.most // 2:
            self.older, self.cache = cache, {}
        return out

    def _fill(self, runs: set[str]) -> None:
        find, cache = self.find, self.cache
        # a word, a word with one mark behind it, or whatever the pattern makes of it
        split = [(r,) if r.isalpha() else (r[:-1], r[-1]) if r[:-1].isalpha() and r[-1] in ".,;:!?" else find(r) for r in runs]
        ids = dict.fromkeys([p for parts in split for p in parts])
        # a word with a mark behind it is often known without
        ids.update({p: cache[p] for p in ids if p in cache})
        unknown = [p for p, known in ids.items() if known is None]
        ids.update(zip(unknown, self.pieces(unknown), strict=True))
        for r, parts in zip(runs, split, strict=True):
            cache[r] = ids[parts[0]] if len(parts) == 1 else b"".join([ids[p] for p in parts])


def groups(texts, most: int = 1 << 20):
    """Rows of an Arrow string array as lists of about ``most`` bytes of text."""
    for lo, hi, _, _ in slices(texts, most):
        yield lo, texts.slice(lo, hi - lo).to_pylist()



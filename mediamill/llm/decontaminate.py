"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Test items are lower-cased, cut into words and into windows of ``size`` consecutive words
(a shorter item is one window).  The windows' 64-bit hashes, sorted, with the items that
have them, are broadcast after a check of their number; every text is scanned once, a
one-bit-per-slot filter throws out nearly all of its windows, the rest is looked up, and
the words of each hit are compared themselves before it counts.  A hit window's words are
marked; a text is contaminated when it holds windows of at least ``least`` items.

When the test windows are more than ``most_windows``, the same scan runs over blocks of
that many windows, one after the other: each pass adds its marks and items to those of the
passes before, which are written between passes, so one bounded broadcast is held at a
time and the result is the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import texts_of, written
from .textkit import ALNUM, LOWER, U64, Words, slices, span_hash

SIZE = 8
MOST_WINDOWS = 2_000_000
_FILTER_BITS = 20
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


class WindowSet:
    """Windows of test items: hash, words and items of each, by window length."""

    def __init__(self, items: list[tuple[str, str]], size: int = SIZE):
        found: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        texts = pa.array([t or "" for _, t in items], pa.string())
        for lo, _, buf, off in slices(texts):
            w = Words(buf, off, ALNUM, True)
            low = LOWER[buf]
            for i, n in enumerate(w.counts().tolist()):
                if not n:
                    continue
                k = min(n, size)
                a = int(w.first[i])
                for p in range(a, a + n - k + 1):
                    body = b" ".join(low[s:e].tobytes() for s, e in zip(w.start[p : p + k], w.end[p : p + k], strict=True))
                    h = int(span_hash(w.hash[p : p + k], np.array([0]), np.array([k]))[0])
                    found.setdefault(k, {}).setdefault(h, {}).setdefault(body, set()).add(items[lo + i][0])
        self.lengths = sorted(found)
        self.hashes, self.bodies, self.filters = {}, {}, {}
        for k, by in found.items():
            keys = np.array(sorted(by), dtype=np.uint64)
            bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
            bits[(keys >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.hashes[k], self.filters[k] = keys, bits
            self.bodies[k] = [by[int(h)] for h in keys]

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, Words, dict[int, set[str]]]]:
        """For each slice of texts: its first row, which words are hit, the words, and the items found by row."""
        for lo, hi, buf, off in slices(texts):
            w = Words(buf, off, ALNUM, True)
            total = len(w.hash)
            cover = np.zeros(total + 1, dtype=np.int64)
            items: dict[int, set[str]] = {}
            low = None
            for k in self.lengths:
                if total < k:
                    continue
                h = span_grams(w.hash, k)
                at = np.flatnonzero(self.filters[k][(h >> U64(64 - _FILTER_BITS)).astype(np.int64)])
                if not len(at):
                    continue
                pos = np.searchsorted(self.hashes[k], h[at])
                pos[pos == len(self.hashes[k])] = 0
                same = self.hashes[k][pos] == h[at]
                at, pos = at[same], pos[same]
                if not len(at):
                    continue
                row = np.searchsorted(w.first, at, side="right") - 1
                inside = at + k <= w.first[row + 1]
                low = LOWER[buf] if low is None else low
                for p, q, r in zip(at[inside].tolist(), pos[inside].tolist(), row[inside].tolist(), strict=True):
                    body = b" ".join(low[s:e].tobytes() for s, e in zip(w.start[p : p + k], w.end[p : p + k], strict=True))
                    names = self.bodies[k][q].get(body)
                    if names:
                        cover[p] += 1
                        cover[p + k] -= 1
                        items.setdefault(r, set()).update(names)
            yield lo, np.cumsum(cover[:-1]) > 0, w, items


def span_grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """``span_hash`` of every run of ``k`` words."""
    n = len(hashes) - k + 1
    at = np.arange(n)
    return span_hash(hashes, at, at + k)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, most: int) -> Iterator[list[tuple[str, str]]]:
    """Test items in blocks of at most ``most`` windows each, one after the other through the driver.

    An item of more windows is cut into parts that share ``size - 1`` words, so the parts have
    the item's windows and no others.
    """
    rows = texts_of(benchmark, id_col, text_col).select(F.col("id").cast("string"), "text").where("text is not null")
    block: list[tuple[str, str]] = []
    held = 0
    for r in rows.toLocalIterator():
        for part in _parts(r["text"], size, most):
            n = max(1, len(part) // 2)  # words need a character and a border, so windows are no more than this
            if block and held + n > most:
                yield block
                block, held = [], 0
            block.append((r["id"], part))
            held += n
    yield block


def _parts(text: str, size: int, most: int) -> Iterator[str]:
    if len(text) // 2 <= most:
        yield text
        return
    words = _WORD.findall(text)
    if len(words) <= size:
        yield text
    for at in range(0, len(words) - size, most):
        yield " ".join(words[at : at + most + size])


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, least: int = 2, most_windows: int = MOST_WINDOWS, clean_text: bool = False, rest: bool = False) -> DataFrame:
    """``id_col, n_words, n_hit, n_items, items, contaminated`` for every row of ``docs``, and ``clean`` on demand.

    ``items`` are the sorted identifiers (as strings) of test items with a window in the text;
    ``clean`` is the text without its hit words, their borders being those of the words.  A null
    or empty text has no words and is not contaminated; an empty ``benchmark`` hits nothing;
    items without words are never found, and an item's null identifier counts as no item.
    Rows are kept one for one, repeated identifiers included; other columns are not read, but
    for ``rest``, which carries all but the text in a struct of that name.
    """
    spark = docs.sparkSession
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]) if rest else F.lit(None).cast("struct<none:int>")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("items"), carried.alias("rest"))
    tail = f", rest {rows.schema['rest'].dataType.simpleString()}"
    blocks = _blocks(benchmark, item_col, item_text_col, size, most_windows)
    kind = "id long, text string, hit binary, items array<string>" + tail
    last = None
    for block in blocks:
        if last is not None:  # another block follows: the marks so far are written, so one broadcast is held at a time
            rows = written(rows.mapInArrow(_marker(last, False, False), kind), "overlaps")
            last.unpersist()
        last = spark.sparkContext.broadcast(WindowSet([x for x in block if x[0] is not None], size))
    kind = "id long, n_words long, n_hit long, items array<string>" + (", clean string" if clean_text else "") + tail
    found = rows.mapInArrow(_marker(last, True, clean_text), kind)
    n_items = F.size("items").cast("long")
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", n_items.alias("n_items"), "items", (n_items >= least).alias("contaminated"), *(["clean"] if clean_text else []), *(["rest"] if rest else []))


def _marker(block, final: bool, clean_text: bool):
    """A pass over texts against one block: marks of earlier blocks come in, all marks or the counts go out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n = b.column(1), b.num_rows
            before, names = b.column(2), b.column(3).to_pylist()
            n_words, n_hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
            items = [set(x or ()) for x in names]
            marks: list[bytes] = [b""] * n
            clean: list[str | None] = texts.to_pylist() if clean_text else []
            for at, hit, w, found in block.value.scan(texts):
                rows = len(w.first) - 1
                for r, got in found.items():
                    items[at + r] |= got
                for r in range(rows):
                    if (old := before[at + r]).is_valid:
                        hit[w.first[r] : w.first[r + 1]] |= np.frombuffer(old.as_py(), dtype=bool)
                if final:
                    run_ = np.concatenate([[0], np.cumsum(hit)])
                    n_words[at : at + rows] = np.diff(w.first)
                    n_hit[at : at + rows] = run_[w.first[1:]] - run_[w.first[:-1]]
                    if clean_text:
                        for r in np.flatnonzero(n_hit[at : at + rows]).tolist():
                            clean[at + r] = _without(w, hit, r)
                else:
                    for r in range(rows):
                        marks[at + r] = hit[w.first[r] : w.first[r + 1]].tobytes()
            lists = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
            if final:
                out, cols = [b.column(0), pa.array(n_words), pa.array(n_hit), lists], ["id", "n_words", "n_hit", "items"]
                if clean_text:
                    out.append(pa.array(clean, pa.string()))
                    cols.append("clean")
            else:
                out, cols = [b.column(0), texts, pa.array(marks, pa.binary()), lists], ["id", "text", "hit", "items"]
            yield pa.RecordBatch.from_arrays([*out, b.column(4)], [*cols, "rest"])

    return run


def _without(w: Words, hit: np.ndarray, r: int) -> str:
    """A text without its hit words; what stands between two hit words goes with them."""
    lo, hi = int(w.offsets[r]), int(w.offsets[r + 1])
    keep = np.ones(hi - lo, dtype=bool)
    a, b = int(w.first[r]), int(w.first[r + 1])
    marks = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
    for s, e in zip(marks[::2].tolist(), marks[1::2].tolist(), strict=True):
        keep[int(w.start[a + s]) - lo : int(w.end[a + e - 1]) - lo] = False
    return w.buf[lo:hi][keep].tobytes().decode("utf-8", "replace")


def items_digest(items) -> Column:
    """Lower-case hex SHA-256 of the comma-joined identifiers."""
    return F.sha2(F.array_join(items, ","), 256)

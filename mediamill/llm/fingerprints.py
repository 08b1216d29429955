"""Document fingerprints: a threshold-scaled sketch.

A text's shingles are all runs of :data:`WIDTH` consecutive bytes of its UTF-8 form (a
shorter text is one shingle).  The sketch keeps every distinct shingle hash below a fixed
fraction of the hash range, so its size follows the text's, sketches of parts merge into
the sketch of the whole by union, and the share of one sketch's hashes that is in another
estimates containment even where one text is a thousand times longer than the other.
Short texts have few hashes below the threshold, or none; so a sketch also keeps the
:data:`LEAST` smallest hashes, which merge as well: the smallest of a union are among the
smallest of its parts.

The likeness of two sketches estimates the Jaccard similarity of their shingle sets: over
all hashes of both below the threshold, or over the :data:`LEAST` smallest of both where
those are more.  Of texts with fewer shingles than that it is exact.

A fingerprint is a string: the number of hashes, then the kept hashes in ascending order,
nine hexadecimal digits (the upper 36 bits) each; those below the threshold begin with 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, texts_of
from .textkit import _BYTE_CODE, _BYTES, U64, mix, slices

WIDTH = 16
SCALE = 16
LEAST = 16
_BITS = 36
_TOP = U64((1 << _BITS) // SCALE)


class Sketches:
    """Kept hashes of many texts: ``values`` in ascending order within each text, whose bounds are in ``first``."""

    def __init__(self, texts: pa.Array, width: int = WIDTH):
        values: list[np.ndarray] = [np.zeros(0, np.uint64)]
        counts: list[np.ndarray] = [np.zeros(0, np.int64)]
        for _, _, buf, off in slices(texts):
            v, n = _kept(buf, off, width)
            values.append(v)
            counts.append(n)
        self.values, self.counts = np.concatenate(values), np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def strings(self) -> list[str]:
        # nine digits are the last ones of sixteen
        digits = np.frombuffer(self.values.astype(">u8").tobytes().hex().encode(), dtype=np.uint8).reshape(-1, 16)[:, 7:]
        text = digits.tobytes().decode()
        bounds = (self.first * 9).tolist()
        return [f"{n}:{text[a:b]}" for n, a, b in zip(self.counts.tolist(), bounds, bounds[1:], strict=False)]

    def keyed(self, below: bool) -> np.ndarray:
        """Rows and hashes in one number each; ``below``: of those under the threshold."""
        keys = (np.repeat(np.arange(len(self.counts), dtype=np.uint64), self.counts) << U64(_BITS)) | self.values
        return keys[self.values < _TOP] if below else keys

    def of(self, row: int) -> np.ndarray:
        return self.values[self.first[row] : self.first[row + 1]]


def _kept(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes of a slice of texts, row by row, and how many each has."""
    n, size = len(buf), np.diff(off)
    up, down = _BYTES.get(n + 1)
    run = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[buf] * up[:n], out=run[1:])
    h = mix((run[width:] - run[:-width]) * down[: n - width + 1], salt=width) >> U64(64 - _BITS) if n >= width else np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(h < _TOP)
    row = np.searchsorted(off, at, side="right") - 1
    inside = at + width <= off[row + 1] if len(at) else np.zeros(0, dtype=bool)
    pair = np.unique((row[inside].astype(np.uint64) << U64(_BITS)) | h[at[inside]])
    few = np.bincount((pair >> U64(_BITS)).astype(np.int64), minlength=len(size)) < LEAST
    # the rows with few: all their hashes, of which the smallest are kept
    rows = np.flatnonzero(few & (size >= width))
    shingles = size[rows] - width + 1
    owner = np.repeat(rows, shingles)
    place = off[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    more = (owner.astype(np.uint64) << U64(_BITS)) | h[place]
    short = np.flatnonzero((size > 0) & (size < width))  # a whole text as one shingle
    if len(short):
        one = mix((run[off[short + 1]] - run[off[short]]) * down[off[short]] + size[short].astype(np.uint64), salt=width) >> U64(64 - _BITS)
        more = np.concatenate([more, (short.astype(np.uint64) << U64(_BITS)) | one])
    more = np.unique(more)
    owner = (more >> U64(_BITS)).astype(np.int64)
    rank = np.arange(len(more)) - np.searchsorted(owner, owner)
    pair = np.union1d(pair, more[rank < LEAST])
    counts = np.bincount((pair >> U64(_BITS)).astype(np.int64), minlength=len(size))
    return pair & U64((1 << _BITS) - 1), counts


def likeness(a: Sketches, b: Sketches, same: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the i-th sketches of both; two empty ones are as alike as their texts are equal (``same``)."""
    n = len(a.counts)
    below = [x.keyed(True) for x in (a, b)]
    ours, theirs, common = (np.bincount((k >> U64(_BITS)).astype(np.int64), minlength=n) for k in (*below, np.intersect1d(*below, assume_unique=True)))
    union = ours + theirs - common
    out = common / np.maximum(union, 1)
    for i in np.flatnonzero(union < LEAST).tolist():
        x, y = a.of(i), b.of(i)
        least = np.union1d(x, y)[:LEAST]
        out[i] = np.isin(least, np.intersect1d(x, y)).mean() if len(least) else float(same[i])
    return out


def parse(fingerprint: str) -> list[int]:
    body = fingerprint.split(":", 1)[1]
    return [int(body[i : i + 9], 16) for i in range(0, len(body), 9)]


def containment(part: str, whole: str) -> float:
    """Estimated share of ``part``'s shingles that ``whole`` has, from fingerprints; 0 for an empty sketch.

    Counted are ``part``'s hashes that ``whole`` would have kept: those below the threshold or
    no larger than its largest, or all if it has so few that none was left out.
    """
    a, b = parse(part), parse(whole)
    most = max([int(_TOP) - 1, *b]) if len(b) >= LEAST else 1 << _BITS
    asked = [x for x in a if x <= most]
    return len(set(asked) & set(b)) / len(asked) if asked else 0.0


def merge(one: str, two: str) -> str:
    """Fingerprint of the union of two shingle sets."""
    both = sorted({*parse(one), *parse(two)})
    kept = [x for i, x in enumerate(both) if i < LEAST or x < int(_TOP)]
    return f"{len(kept)}:" + "".join(f"{x:09x}" for x in kept)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_chars, fingerprint`` of every text; a null is an empty text, whose sketch is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).fill_null("")
            for lo, hi, _, _ in slices(texts):
                part = texts.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([len(t) for t in part.to_pylist()], pa.int64()), pa.array(Sketches(part).strings())], ["id", "n_chars", "fingerprint"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "id long, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows dealt by descending identifier into runs, each run closed by a copy of the row that follows it.

    Bounds come from the identifiers alone; only each run's greatest identifier (one number a
    run) passes through the driver.  A null identifier counts as the smallest.
    """
    n = partitions(rows.sparkSession)
    key = F.coalesce("id", F.lit(-(1 << 63)))
    ids = rows.select(key.alias("k"))
    bounds = ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0]
    bounds = np.unique(np.array(bounds if bounds else [0], dtype=np.int64))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(bounds, k)
            order = np.lexsort((k, at))
            at, k = at[order], k[order]
            last = np.flatnonzero(np.append(at[1:] != at[:-1], True)) if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(at[last], pa.int32()), pa.array(k[last], pa.int64())], ["bucket", "k"])

    heads = {r.bucket: r.k for r in ids.mapInArrow(buckets, "bucket int, k long").groupBy("bucket").agg(F.max("k").alias("k")).collect()}
    filled = sorted(heads)
    follows = {heads[b]: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}  # the head of each run ends the run above; the greatest ends the lowest

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads_ = np.array(sorted(follows), dtype=np.int64)
        for b in batches:
            k = b.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            at = np.searchsorted(bounds, k)
            extra = np.flatnonzero(np.isin(k, heads_))
            take = np.concatenate([np.arange(len(k)), extra])
            bucket = np.concatenate([at, [follows[int(x)] for x in k[extra]]]).astype(np.int32)
            tail = np.concatenate([np.zeros(len(k), bool), np.ones(len(extra), bool)])
            out = b.take(pa.array(take)) if len(extra) else b
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(bucket), pa.array(tail)], ["id", "text", "bucket", "tail"])

    dealt = rows.mapInArrow(deal, "id long, text string, bucket int, tail boolean")
    return dealt.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "tail", F.desc("id"), "text")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The next row is that of the next smaller identifier (ties: the next text, nulls first),
    after the last one the first; in the edited text the last half of the code points (rounded
    down) is replaced by the next text's first as many, or all.  A null text counts as empty,
    a single row is its own next.  Every row of ``docs`` gives one row.
    """
    import hashlib

    rows = texts_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before: its next one is still to come
        for b in batches:
            texts = b.column(1)
            for lo, hi, _, _ in slices(texts):
                part = zip(b.column(0).slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo).to_pylist(), b.column(2).slice(lo, hi - lo).to_pylist(), b.column(3).slice(lo, hi - lo).to_pylist(), strict=True)
                pairs = []
                for row in part:
                    if held is not None and held[2] == row[2] and not held[3]:
                        pairs.append((held[0], held[1] or "", row[1] or ""))
                    held = row
                if pairs:
                    yield finish(pairs)

    def finish(pairs: list[tuple]) -> pa.RecordBatch:
        ids, own, following = zip(*pairs, strict=True)
        edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(own, following, strict=True)]
        a, e, f = (Sketches(pa.array(x, pa.large_string())) for x in (own, edited, following))
        near_edited = likeness(a, e, np.array([x == y for x, y in zip(own, edited, strict=True)]))
        near_next = likeness(a, f, np.array([x == y for x, y in zip(own, following, strict=True)]))
        columns = [pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(a.strings()), pa.array(e.strings()), pa.array(near_edited), pa.array(near_next)]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(rows).mapInArrow(run, kind).withColumnRenamed("id", id_col)

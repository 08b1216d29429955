"""Substring dedup by seed and extend over winnowed anchors.

Winnowing picks in every window of ``length`` words the least of its ``seed``-word hashes
(the leftmost on ties).  The choice depends on the window's words alone, so equal windows
have equal anchors at equal places: an exact repeat of ``length`` words or more is found by
joining documents on anchors, and texts that share no anchor share no window.  Windows
with one anchor follow one another; together with the words that they cover they are the
anchor's *extent*, its seed extended both ways as far as windows reach it.

1. Extents are grouped by anchor and content (hashes of 64 bits each), keeping the earliest.
   Every later extent of equal content is a repeat in all its windows.
2. Where an anchor has several contents, the earliest extent of each is laid out in its
   windows, which are grouped by anchor and window hash; a window that isn't the earliest is
   a repeat.  (Only the earliest extents matter: any other has an equal one before it.)
3. The windows found are merged into maximal repeated spans of each text.

Both groupings combine on the map side, so a passage that a third of all texts share costs
one row a task, and the joins back to the occurrences have one row a key on one side, so
their hot keys can be split.  Nothing is paired within a group.  Two different passages are
mistaken for one only if they share an anchor and all 64 bits of a hash besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, written
from .textkit import SPACED, Words, grams, inside_one, slices, span_hash

LENGTH = 20
SEED = 8
_ROWS = 1 << 16


def _anchors(w: Words, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Windows of the texts (start, owner), the anchor of each, and all seed hashes."""
    start, owner = inside_one(w.first, length, len(w.hash))
    g = grams(w.hash, seed)
    if not len(start):
        return start, owner, start, g
    view = np.lib.stride_tricks.sliding_window_view(g, length - seed + 1)
    least = np.empty(len(view), dtype=np.int64)
    for a in range(0, len(view), _ROWS):
        least[a : a + _ROWS] = view[a : a + _ROWS].argmin(axis=1)
    return start, owner, start + least[start], g


def extents(w: Words, length: int, seed: int) -> dict[str, np.ndarray]:
    """Extents of all texts: owner, first window, number of windows, anchor hash, content hash."""
    start, owner, anchor, g = _anchors(w, length, seed)
    if not len(start):
        none = np.zeros(0, dtype=np.int64)
        return {"owner": none, "start": none, "n": none, "anchor": none, "content": none}
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    n = np.diff(np.append(new, len(start)))
    lo, at = start[new], anchor[new]
    # the anchor's place in the extent is part of its content
    content = span_hash(w.hash, lo, lo + n + length - 1) + (at - lo).astype(np.uint64)
    return {"owner": owner[new], "start": lo, "n": n, "anchor": g[at].view(np.int64), "content": content.view(np.int64)}


def _extent_rows(length: int, seed: int):
    @lean("substring")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, buf, off in slices(b.column(1)):
                w = Words(buf, off, SPACED, False)
                x = extents(w, length, seed)
                if len(x["owner"]):
                    ids = b.column(0).take(pa.array(x["owner"] + lo))
                    yield pa.RecordBatch.from_arrays([pa.array(x["anchor"]), pa.array(x["content"]), ids, pa.array((x["start"] - w.first[x["owner"]]).astype(np.int32)), pa.array(x["n"].astype(np.int32))], ["anchor", "content", "id", "start", "n"])

    return run


def _window_rows(length: int, seed: int):
    """Windows of the extents that start at the given places of each text."""

    @lean("substring")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(2).is_valid())
            wanted = b.column(2).to_pylist()
            for lo, hi, buf, off in slices(b.column(1)):
                w = Words(buf, off, SPACED, False)
                x = extents(w, length, seed)
                if not len(x["owner"]):
                    continue
                key = x["owner"] * (1 << 32) + (x["start"] - w.first[x["owner"]])
                ask = np.array([(r - lo) * (1 << 32) + s for r in range(lo, hi) for s in wanted[r] or ()], dtype=np.int64)
                pick = np.flatnonzero(np.isin(key, ask))
                if not len(pick):
                    continue
                n = x["n"][pick]
                each = np.repeat(pick, n)
                start = x["start"][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                owner = x["owner"][each]
                h = span_hash(w.hash, start, start + length).view(np.int64)
                ids = b.column(0).take(pa.array(owner + lo))
                yield pa.RecordBatch.from_arrays([pa.array(x["anchor"][each]), pa.array(h), ids, pa.array((start - w.first[owner]).astype(np.int32))], ["anchor", "content", "id", "start"])

    return run


def _cut(length: int, whole: bool):
    """Counts, spans and kept text from the repeated windows of each text; with ``whole``, texts that lose nothing stay as they are."""

    @lean("substring")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b.column(2)
            for lo, hi, buf, off in slices(b.column(1)):
                w = Words(buf, off, SPACED, False, hashes=False)
                total = len(w.start)
                cover = np.zeros(total + 1, dtype=np.int64)
                for r in range(lo, hi):
                    if marks[r].is_valid:
                        inner = marks[r].values
                        s = inner.field(0).to_numpy().astype(np.int64) + w.first[r - lo]
                        np.add.at(cover, s, 1)
                        np.add.at(cover, s + inner.field(1).to_numpy() + length - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                run_ = np.concatenate([[0], np.cumsum(gone)])
                n_removed = run_[w.first[1:]] - run_[w.first[:-1]]
                texts, spans = _kept(w, gone, hi - lo)
                if whole:
                    texts = [t if n else own.as_py() for t, n, own in zip(texts, n_removed.tolist(), b.column(1).slice(lo, hi - lo), strict=True)]
                columns = [b.column(0).slice(lo, hi - lo), pa.array(w.counts()), pa.array(n_removed), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())])))]
                yield pa.RecordBatch.from_arrays([*columns, *[c.slice(lo, hi - lo) for c in b.columns[3:]]], ["id", "n_words", "n_removed", "kept", "spans", *b.schema.names[3:]])

    return run


def _kept(w: Words, gone: np.ndarray, rows: int) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Kept words joined by one space, and the removed runs of words, of each text."""
    stay = np.flatnonzero(~gone)
    size = (w.end - w.start)[stay]
    # each kept word and the space behind it, gathered in one go
    ends = np.cumsum(size + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, dtype=np.uint8)
    if len(stay):
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(ends - size - 1, size) + inside] = w.buf[np.repeat(w.start[stay], size) + inside]
    first = np.searchsorted(stay, w.first)
    at = np.concatenate([[0], ends])[first]
    body = out.tobytes()
    texts = [body[a : b - 1].decode("utf-8", "replace") if b > a else "" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    if gone.any():
        owner = np.repeat(np.arange(rows), w.counts())
        new = np.concatenate([[True], (gone[1:] != gone[:-1]) | (owner[1:] != owner[:-1])])
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(gone)))
        for s, n in zip(begin[gone[begin]].tolist(), length[gone[begin]].tolist(), strict=True):
            r = int(owner[s])
            spans[r].append((s - int(w.first[r]), n))
    return texts, spans


def _keyed(docs: DataFrame, id_col: str, text_col: str, rest: bool) -> tuple[DataFrame, str, Column, Column, Column]:
    """Rows with a key that no two different texts share, and an order of places that one number holds where the keys allow it."""
    id_, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    by_id = docs.groupBy(id_.alias("i")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.octet_length(text)).alias("longest"))
    seen = by_id.agg(F.count_if(F.expr("rows > 1 or i is null")).alias("odd"), F.min("i").alias("low"), F.max("i").alias("high"), F.max("longest").alias("longest")).first()
    keep = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest")] if rest else []
    low, high, longest = seen.low or 0, seen.high or 0, seen.longest or 0
    bits = max(1, int(longest // 2 + 1).bit_length())
    if not seen.odd and (high - low + 1).bit_length() + bits < 63:
        rows = docs.select(id_.alias("id"), text.alias("text"), id_.alias("own"), *keep)
        place = F.shiftleft(F.col("id") - F.lit(low), bits) + F.col("start")
        return rows, "long", place, F.shiftright(F.col("place"), bits) + F.lit(low), F.col("place").bitwiseAND((1 << bits) - 1).cast("int")
    # null or repeated identifiers, or a range too wide: the key is the identifier and the text's digest
    ordered = F.coalesce(F.lpad(F.hex(id_.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit(" " * 16))
    rows = docs.select(F.concat(ordered, F.md5(F.coalesce(text, F.lit("")))).alias("id"), text.alias("text"), id_.alias("own"), *keep)
    return rows, "string", F.struct("id", "start"), F.col("place.id"), F.col("place.start")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, rest: bool = False, whole: bool = False) -> DataFrame:
    """``id_col, n_words, n_removed, kept, spans`` for every row: the text without the words of repeated windows.

    Words are runs of anything but ASCII white space, unchanged.  A window of ``length`` words
    is repeated when its words also start earlier, in a smaller identifier or before it in
    its own text; ``spans`` are the maximal runs of words that repeated windows cover
    (first word, number of words) and ``kept`` joins the other words by one space.  A null text
    has no words; texts of fewer than ``length`` words lose none.  Rows that share an
    identifier are told apart by their text and ordered by its digest; rows equal in both
    count as one place, so neither makes the other a repeat; null identifiers come first.
    With ``rest``, a struct of that name carries all columns but the text; with ``whole``,
    ``kept`` of a text that loses no word is that text with its own white space, or null.
    """
    rows, kind, place, id_of, start_of = _keyed(docs, id_col, text_col, rest)
    tail = [("own", "long")] + ([("rest", rows.schema["rest"].dataType.simpleString())] if rest else [])
    more = "".join(f", {n} {t}" for n, t in tail)
    extents_of = rows.select("id", "text").mapInArrow(_extent_rows(length, seed), f"anchor long, content long, id {kind}, start int, n int").withColumn("place", place).drop("id", "start")
    shared = extents_of.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), F.min("content").alias("least"), F.max("content").alias("most"))
    # sides with one row a key are written before they are joined: a join of two plain exchanges can split a hot key
    shared = written(shared.where("times > 1").select("anchor", (F.col("least") < F.col("most")).alias("mixed")), "anchors")
    found = written(extents_of.join(shared, "anchor"), "repeats")
    earliest = written(found.groupBy("anchor", "content").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times"), F.first("mixed").alias("mixed")), "earliest")
    later = found.join(earliest.where("times > 1").select("anchor", "content", "first"), ["anchor", "content"]).where("place > first")
    later = later.select(id_of.alias("id"), start_of.alias("start"), "n")

    asked = earliest.where("mixed").select(F.col("first").alias("place")).select(id_of.alias("id"), start_of.alias("start")).groupBy("id").agg(F.collect_list("start").alias("starts"))
    # both joins of the texts are left joins over the same columns, so one exchange of the texts serves both
    laid = rows.join(asked, "id", "left").select("id", "text", "starts", *[n for n, _ in tail])
    laid = laid.mapInArrow(_window_rows(length, seed), f"anchor long, content long, id {kind}, start int").withColumn("place", place).drop("id", "start")
    firsts = laid.groupBy("anchor", "content").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor", "content", "first")
    firsts = written(firsts, "windows")
    single = laid.join(firsts, ["anchor", "content"]).where("place > first").select(id_of.alias("id"), start_of.alias("start"), F.lit(1).alias("n"))

    marks = later.unionByName(single).groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    joined = rows.join(marks, "id", "left").select("id", "text", "marks", *[n for n, _ in tail])
    out = joined.mapInArrow(_cut(length, whole), f"id {kind}, n_words long, n_removed long, kept string, spans array<struct<first:int,words:int>>{more}")
    return out.select(F.col("own").alias(id_col), "n_words", "n_removed", "kept", "spans", *(["rest"] if rest else []))

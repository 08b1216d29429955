"""Token counts by a map-side two-tier lookup.

A SentencePiece BPE model never joins characters over the border in front of a run of
spaces (no piece has a space mark after another character) nor over a line end (no piece
holds one), so a text's token count is the sum of the counts of its pre-tokens: runs of
spaces with the characters that follow, and line ends.  Tier one is a hash table of
frequent pre-tokens and their lengths, of bounded size, broadcast to all tasks; tier two
is a cache in each Python worker, of bounded size, which the model itself fills with the
misses of a batch.  No pre-token is shuffled.

Both properties of the model are checked when it is loaded; a model without them, and any
text that holds the space mark itself or a NUL, goes through the model as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import heavy_hitters, texts_of, worker_cache

FREQUENT = 65_536
CACHE = 400_000
_GROUP_BYTES = 1 << 20

split = re.compile(r" *[^ \n]+|\n| +").findall
_ODD = re.compile("[▁\x00]")


def _pretokens(text: str) -> list[str]:
    return split(" " + text)


class PieceCounter:
    """Counts of one SentencePiece model; ``table`` is tier one."""

    def __init__(self, path: str, table: dict[str, int] | None = None, cache: int = CACHE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.mark = "▁"
        probe = self.model.encode(" a  b\nc ", out_type=str)
        self.local = (
            not any(self.mark in p.lstrip(self.mark) for p in pieces)
            and not any("\n" in p for p in pieces)
            and "".join(probe).replace("<0x0A>", "\n") == f"{self.mark}{self.mark}a{self.mark}{self.mark}b\nc{self.mark}"
        )
        self.table = table or {}
        self.cache: dict[str, int] = {}
        self.most = cache
        bare = self.model.encode("\n")
        self.head = len(bare)  # the mark that the model puts in front, and the line end

    def encode_lengths(self, tokens: list[str]) -> list[int]:
        """Lengths of pre-tokens by the model: a leading space is the mark that it adds itself; without one, a line end stands before."""
        inputs = [t[1:] if t[0] == " " else "\n" + t for t in tokens]
        lengths = []
        for t, ids, given in zip(tokens, self.model.encode(inputs, num_threads=1), inputs, strict=True):
            if t == "\n":
                lengths.append(self.head - 1)
            elif t[0] == " ":
                lengths.append(len(ids) if given else 1)  # a lone space is the mark alone
            else:
                lengths.append(len(ids) - self.head)
        return lengths

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        todo: list[tuple[int, list[str]]] = []
        whole: list[int] = []
        missing: dict[str, None] = {}
        table, cache = self.table, self.cache
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.local or _ODD.search(text):
                whole.append(i)
                continue
            tokens = _pretokens(text)
            try:
                out[i] = sum([table[t] if t in table else cache[t] for t in tokens])
            except KeyError:
                missing.update(dict.fromkeys(t for t in tokens if t not in table and t not in cache))
                todo.append((i, tokens))
        if missing:
            if len(cache) + len(missing) > self.most:
                kept = {t: cache[t] for _, tokens in todo for t in tokens if t in cache}
                cache.clear()
                cache.update(kept)
            names = list(missing)
            cache.update(zip(names, self.encode_lengths(names), strict=True))
        for i, tokens in todo:
            out[i] = sum([table[t] if t in table else cache[t] for t in tokens])
        for i in whole:
            out[i] = len(self.model.encode(texts[i]))
        return out


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, frequent: int = FREQUENT) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    A null or empty text has 0 bytes and 0 tokens.  Rows are neither merged nor dropped, so
    repeated rows and null identifiers come out as they came in; other columns are not read.
    ``frequent`` bounds the broadcast table, :data:`CACHE` each worker's cache.
    """
    spark = docs.sparkSession
    rows = texts_of(docs, id_col, text_col)
    common = heavy_hitters(rows, _pretokens, frequent)
    first = PieceCounter(model_path)
    names = [w for w, _ in common if not _ODD.search(w)]
    table = spark.sparkContext.broadcast(dict(zip(names, first.encode_lengths(names), strict=True)) if first.local and names else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"{model_path}#{table._jbroadcast.id() if hasattr(table, '_jbroadcast') and table._jbroadcast else id(table)}"
        kept = worker_cache("token_counts")
        if key not in kept:
            kept.clear()
            kept[key] = PieceCounter(model_path, table.value)
        counter = kept[key]
        for b in batches:
            ids, column = b.column(0), b.column(1)
            n_bytes = [len(x.as_buffer()) if x.is_valid else 0 for x in column.cast(pa.binary())]
            out, lo = [0] * len(n_bytes), 0
            while lo < len(n_bytes):
                hi, size = lo, 0
                while hi < len(n_bytes) and (hi == lo or size + n_bytes[hi] <= _GROUP_BYTES):
                    size += n_bytes[hi]
                    hi += 1
                out[lo:hi] = counter.counts(column.slice(lo, hi - lo).to_pylist())
                lo = hi
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(out, pa.int64())], ["id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

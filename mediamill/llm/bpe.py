"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words and their token ids are compiled into a shared-suffix automaton
(:mod:`.lexicon`), written once to the shared folder and memory-mapped by every worker.
A batch's words that the automaton accepts get their ids from it; the others are merged
exactly, by rank, all at once (:class:`.wordbpe.Merger`), and a bounded worker cache keeps
runs of characters that came up before.  Decoding maps ids back to token strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import mapped, put
from .lexicon import LONGEST, Lexicon, build
from .shared import heavy_hitters, scratch, texts_of, worker_cache
from .wordbpe import ChunkEncoder, groups

FREQUENT = 32_768


class LexiconEncoder(ChunkEncoder):
    """Pieces by the automaton, then by exact merging; by the library where the file is of another kind."""

    def __init__(self, path: str, lexicon: Lexicon | None):
        super().__init__(path)
        self.lexicon = lexicon

    def pieces(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        out: list[bytes | None] = [None] * len(words)
        rest = range(len(words))
        if self.lexicon is not None:
            numbers = self.lexicon.numbers(raw)
            for i in np.flatnonzero(numbers >= 0).tolist():
                out[i] = self.lexicon.ids_of(int(numbers[i]))
            rest = np.flatnonzero(numbers < 0).tolist()
        for i, ids in zip(rest, super().pieces([words[i] for i in rest]), strict=True):
            out[i] = ids
        return out


class Decoder:
    """Token strings joined as the library joins them: by spaces where the file names no decoder, else by the library itself."""

    def __init__(self, path: str):
        self.library = ChunkEncoder(path)
        spec = self.library.spec
        self.plain = not spec.get("decoder")
        self.library = self.library.library
        size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.tokens = [self.library.id_to_token(i) or "" for i in range(size)]

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        if not self.plain:
            return self.library.decode(numbers, skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, numbers))


def _encoder(path: str, at: str) -> LexiconEncoder:
    """The worker's encoder for a lexicon."""
    kept = worker_cache("bpe")
    if kept.get("lexicon") != at:
        kept.clear()
        kept.update(lexicon=at, encoder=LexiconEncoder(path, Lexicon(mapped(at))))
    return kept["encoder"]


def _decoder(path: str) -> Decoder:
    kept = worker_cache("bpe")
    if ("decoder", path) not in kept:
        kept["decoder", path] = Decoder(path)
    return kept["decoder", path]


def _words(text: str) -> list[str]:
    return [w for w in text.lower().split() if w.isalpha()]


def compile_lexicon(docs: DataFrame, path: str, frequent: int = FREQUENT) -> str:
    """The address of a transducer of the ``frequent`` commonest words over all texts, in the shared folder."""
    import unicodedata

    words = [w for w, _ in heavy_hitters(docs, _words, frequent)]
    encoder = LexiconEncoder(path, None)
    named = {w.encode() for w in words if unicodedata.is_normalized("NFC", w) and w == w.lower() and len(encoder.find(w)) == 1}
    chosen = sorted(w for w in named if len(w) <= LONGEST) if encoder.fast else []
    ids = encoder.merger.encode(chosen) if chosen else []
    return put(scratch(docs.sparkSession, "lexicon"), "words.madfa", build({w: np.frombuffer(i, dtype="<u4").tolist() for w, i in zip(chosen, ids, strict=True)}))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, lexicon: str | None = None) -> DataFrame:
    """``id_col, n_tokens, ids``: token ids of every whole text as little-endian unsigned 32-bit integers in a binary column.

    No begin, end or added special tokens; special strings inside a text become their ids, as
    in the library.  A null or empty text has no tokens.  Rows are kept one for one.
    """
    rows = texts_of(docs, id_col, text_col)
    at = lexicon or compile_lexicon(rows, path, frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path, at)
        for b in batches:
            for lo, texts in groups(b.column(1)):
                ids = coder.encode(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    return rows.mapInArrow(run, "id long, n_tokens long, ids binary").select(F.col("id").alias(id_col), "n_tokens", "ids")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_tokens, ids, decoded`` from the rows of :func:`encode`; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _decoder(path)
        for b in batches:
            texts = [coder.decode(i or b"") for i in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.large_string()).cast(pa.string())], [*b.schema.names, "decoded"])

    return encoded.select(F.col(id_col).alias("id"), "n_tokens", "ids").mapInArrow(run, "id long, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: digests of the ids and of the text decoded from them.

    Encoding and decoding run in one pass, so neither ids nor decoded texts leave the worker.
    """
    rows = texts_of(docs, id_col, text_col)
    at = compile_lexicon(rows, path, frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, back = _encoder(path, at), _decoder(path)
        for b in batches:
            n: list[int] = []
            one: list[str] = []
            two: list[str] = []
            for _, texts in groups(b.column(1)):
                for ids in coder.encode(texts):
                    n.append(len(ids) // 4)
                    one.append(hashlib.sha256(ids).hexdigest())
                    two.append(hashlib.sha256(back.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)

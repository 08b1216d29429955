"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence are multiplied for each language ``l``:

* the text's likelihood under byte four-gram profiles, tempered: its logarithm is divided by
  four, since each byte stands in four grams, and its weight tends to that of
  :data:`EVIDENCE` bytes as texts get longer, since passages of a page hang together,
* how often pages of ``l`` declare the language that this page's markup declares,
* how often pages of ``l`` have this page's address suffix,
* a prior for the page's host, smoothed towards that of its domain, which is smoothed
  towards that of all pages.

Counts for the last three are sums of the pages' text-only posteriors by declared language,
suffix, host, domain and overall - grouped aggregations over all pages, each partly done
before its shuffle, so a host with a third of all pages sends one row a task.  A page's own
share is taken out of its counts before they are used on it.

The profiles are fitted on at most ``fit_rows`` documents whose language is known (those
with the least hash of their identifier): the classifier's documented bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textkit import LOWER, U64, slices

FIT_ROWS = 8_000
MOST_LANGUAGES = 200
BITS = 15
SMOOTHING = 0.5
EVIDENCE = 64
STRENGTH = 8.0  # pseudo-pages behind each smoothed count

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|noscript|template)\b.*?(?:</\1\s*>|\Z)|<[^>]*(?:>|\Z)", re.S | re.I)
_ENTITY = re.compile(r"&#?\w{1,10};?")
_DECLARED = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})(?![a-zA-Z])", re.I)
_META = re.compile(r"<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([a-zA-Z]{2,3})(?![a-zA-Z])", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)")


def visible(html: str | None) -> str:
    return _ENTITY.sub(" ", _HIDDEN.sub(" ", html)) if html else ""


def declared(html: str | None) -> str:
    """Primary subtag that the markup declares, in lower case; empty if none."""
    m = html and (_DECLARED.search(html) or _META.search(html))
    return m[1].lower() if m else ""


def address(url: str | None) -> tuple[str, str, str]:
    """Suffix, domain and host of an address; empty strings where it has none."""
    m = url and _HOST.match(url)
    if not m:
        return "", "", ""
    host = m[1].lower().rstrip(".")
    parts = host.split(".")
    if len(parts) < 2 or parts[-1].isdigit():
        return "", host, host
    return parts[-1], ".".join(parts[-2:]), host


def _grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all four-grams that lie in one text, and the texts' bounds in them."""
    low = LOWER[buf].astype(np.uint64)
    if len(low) < 4:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    v = low[:-3] | low[1:-2] << U64(8) | low[2:-1] << U64(16) | low[3:] << U64(24)
    bucket = ((v * U64(0x9E3779B97F4A7C15)) >> U64(64 - BITS)).astype(np.int64)
    keep = np.ones(len(bucket), dtype=bool)
    for back in (1, 2, 3):
        at = off[1:-1] - back
        keep[at[(at >= 0) & (at < len(keep))]] = False
    run = np.concatenate([[0], np.cumsum(keep)])
    return bucket[keep], run[np.minimum(off, len(keep))]


class Profiles:
    """Log-probabilities of the buckets in each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = counts + SMOOTHING
        self.table = np.log(p / p.sum(axis=0, keepdims=True)).astype(np.float32)

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for lo, hi, buf, off in slices(pa.array(texts, pa.large_string())):
            bucket, first = _grams(buf, off)
            for j in range(len(self.languages)):
                run = np.concatenate([[0.0], np.cumsum(self.table[bucket, j], dtype=np.float64)])
                out[lo:hi, j] = (run[first[1:]] - run[first[:-1]]) / 4 * EVIDENCE / (EVIDENCE + np.diff(first))
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, most_languages: int = MOST_LANGUAGES) -> Profiles:
    """Profiles of the languages of at most ``fit_rows`` documents, at most the ``most_languages`` that have most of them (ties by name); without any, one language "und".

    Null identifiers and languages are passed over, a null text counts as empty; rows that share
    an identifier are all used.
    """
    spark = docs.sparkSession
    id_ = F.col(id_col).cast("long")
    chosen = docs.where(F.col(lang_col).isNotNull() & id_.isNotNull()).select(id_.alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    chosen = spark.createDataFrame([(r[0],) for r in chosen.collect()], "id long")  # at most fit_rows numbers
    sample = docs.select(id_.alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null").join(F.broadcast(chosen), "id").select("lang", "text")
    sample = written(sample, "profiled")
    named = sample.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).select("lang")
    sample = sample.join(F.broadcast(named), "lang").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            for lo, hi, buf, off in slices(b.column(1)):
                bucket, first = _grams(buf, off)
                for r in range(hi - lo):
                    n = np.bincount(bucket[first[r] : first[r + 1]], minlength=1 << BITS)
                    held[langs[lo + r]] = held.get(langs[lo + r], 0) + n
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at].astype(np.int64))], ["lang", "bucket", "n"])

    # at most one row for each language and bucket
    rows = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    found = rows.column("lang").combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
    languages = sorted(found.dictionary.to_pylist()) or ["und"]
    counts = np.zeros((1 << BITS, len(languages)))
    if rows.num_rows:
        place = np.array([languages.index(x) for x in found.dictionary.to_pylist()])[found.indices.to_numpy()]
        counts[rows.column("bucket").to_numpy(), place] = rows.column("n").to_numpy()
    return Profiles(languages, counts)


def fuse(ll: np.ndarray, own: np.ndarray, everywhere: np.ndarray, declared_n: np.ndarray, suffix_n: np.ndarray, domain_n: np.ndarray, host_n: np.ndarray) -> np.ndarray:
    """Logarithms of the posteriors (not normalised) of pages in rows, languages in columns; counts still hold the pages' own shares."""
    n = ll.shape[1]
    everywhere, declared_n, suffix_n, domain_n, host_n = (np.maximum(x - own, 0.0) for x in (everywhere, declared_n, suffix_n, domain_n, host_n))
    total = everywhere.sum(axis=1, keepdims=True)
    prior = (everywhere + 1.0 / n) / (total + 1.0)
    for counts in (domain_n, host_n):
        prior = (counts + STRENGTH * prior) / (counts.sum(axis=1, keepdims=True) + STRENGTH)
    out = ll + np.log(prior)
    for counts in (declared_n, suffix_n):
        rate = (counts.sum(axis=1, keepdims=True) + 0.5) / (total + 1.0)
        out += np.log((counts + STRENGTH * rate) / (everywhere + STRENGTH))
    return out


def identify(pages: DataFrame, profiles: Profiles, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, lang, probability, text_lang, declared, host`` for every page.

    A null or empty page has no text evidence and rests on its address and on the priors; a null
    address has an empty host, suffix and domain, whose pages form a group of their own.
    Ties go to the language that comes first by name.  Rows are kept one for one.
    """
    spark = pages.sparkSession
    held = spark.sparkContext.broadcast(profiles)
    n = len(profiles.languages)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for b in batches:
            for lo, hi, _, _ in slices(b.column(2)):
                sources, urls = b.column(2).slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo)
                ll = p.likelihoods([visible(s) for s in sources])
                ll -= ll.max(axis=1, keepdims=True)
                post = np.exp(ll)
                post /= post.sum(axis=1, keepdims=True)
                where = [address(u) for u in urls.to_pylist()]
                columns = [pa.array([declared(s) for s in sources], pa.string()), *(pa.array([w[i] for w in where], pa.string()) for i in range(3))]
                lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (ll, post)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), urls, *columns, *lists], ["id", "url", "declared", "suffix", "domain", "host", "ll", "post"])

    frame = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = "id long, url string, declared string, suffix string, domain string, host string, ll array<double>, post array<double>"
    base = written(frame.mapInArrow(read, kind), "evidence")

    def sums(*by: str) -> DataFrame:
        grouped = base.groupBy(*by) if by else base.groupBy()
        return grouped.agg(*[F.sum(F.col("post")[i]).alias(f"s{i}") for i in range(n)]).select(*by, F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(n)]).alias("_".join(by or ("all",)) + "_n"))

    # overall: one row; declared: subtags of two or three letters, so at most 26**2 + 26**3 + 1 rows
    every = F.array(*[F.lit(float(x)) for x in sums().first()[0]])
    joined = base.withColumn("all_n", every).join(F.broadcast(sums("declared")), "declared")
    # one row a key, written first: joins of two plain exchanges, in which the rows of a hot host can be split
    for by in ("suffix", "domain", "host"):
        joined = joined.join(written(sums(by), by), by)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = np.array(held.value.languages)
        for b in batches:
            if not b.num_rows:
                continue
            ll, *counts = (b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for k in range(4, 11))
            log = fuse(ll, *counts)
            log -= log.max(axis=1, keepdims=True)
            lang, text = languages[log.argmax(axis=1)], languages[ll.argmax(axis=1)]
            columns = [*b.columns[:2], pa.array(lang.tolist(), pa.string()), pa.array(1 / np.exp(log).sum(axis=1)), pa.array(text.tolist(), pa.string()), *b.columns[2:4]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "url", "lang", "probability", "text_lang", "declared", "host"])

    ready = joined.select("id", "url", "declared", "host", "ll", "post", "all_n", "declared_n", "suffix_n", "domain_n", "host_n")
    out = ready.mapInArrow(decide, "id long, url string, lang string, probability double, text_lang string, declared string, host string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "lang", "probability", "text_lang", "declared", "host")

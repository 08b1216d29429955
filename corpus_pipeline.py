"""A corpus pipeline: documents without toxic texts, near-copies, repeated passages and benchmark leaks, encoded.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read back as the next one's ``docs``.  Every stage works on all rows that its
predecessor kept; all but the last return the columns of ``documents``.

The result has ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediamill.llm import bpe, decontaminate, minhash_dedup, substring_dedup, toxicity
from mediamill.llm.queries import WORD_MODEL
from mediamill.llm.shared import written


def _whole(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with all other columns in a struct, out of the way of an operator's own names."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))


def _columns(docs: DataFrame, fields: dict[str, Column]) -> list[Column]:
    return [fields.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject, unchanged.

    Null and empty texts stay.  Each row is judged by its own text, so rows that share an
    identifier may fare differently; columns named like a score are carried as they are.
    Without labels of both kinds every document stays.
    """
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(_whole(docs), lexicon).where("predicted = 0").select(*_columns(docs, {"text": F.col("text")}))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: that of the smallest identifier (null last), of these that of the least text hash.

    Null, empty and blank texts are in no group and stay.  A row is named by identifier and
    text, so rows that share an identifier leave or stay each for itself; of rows equal in
    both, one stays.
    """
    found = written(minhash_dedup.near_duplicates(docs, detail=True).where("n_shingles > 0").select("group", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).alias("row")), "groups")
    first = found.groupBy("group").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("size"))
    first = written(first.where("size > 1").select("group", F.col("row").alias("first")), "first")
    gone = written(found.join(first, "group").where("row != first").select("row.id", "row.hash").distinct(), "gone")
    same = docs.doc_id.cast("long").eqNullSafe(gone.id) & (F.xxhash64(docs.text.cast("string")) == gone.hash)
    left = docs.join(gone, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    # rows equal in identifier and text: rare, so only they are gathered
    again = written(found.join(first, "group").where("row = first").groupBy("row").count().where("count > 1").select("row.id", "row.hash"), "again")
    if again.isEmpty():
        return left
    twice = left.doc_id.cast("long").eqNullSafe(again.id) & (F.xxhash64(left.text.cast("string")) == again.hash)
    one = left.join(again, twice, "left_semi").withColumns({"_id": F.col("doc_id"), "_hash": F.xxhash64(F.col("text").cast("string"))})
    one = one.dropDuplicates(["_id", "_hash"]).drop("_id", "_hash")
    return left.join(again, twice, "left_anti").unionByName(one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that stand earlier in the corpus; texts without repeats stay as they are, null ones too.

    Rows that share an identifier are told apart by their texts; rows equal in both count as
    one place, so neither makes the other a repeat.
    """
    found = substring_dedup.find_repeats(docs, rest=True, whole=True)
    changed = F.col("n_removed") > 0
    fields = {"text": F.col("kept"), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("rest.n_chars"))}
    return found.select(*_columns(docs, fields))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of no benchmark item, or of one: its words are taken out of the text.

    Each row is judged by its own text; null and empty texts stay.  Without benchmark items
    every document stays as it is.
    """
    found = decontaminate.find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean_text=True, rest=True)
    changed = F.col("n_hit") > 0
    fields = {"text": F.col("clean"), "n_chars": F.when(changed, F.length("clean").cast("long")).otherwise(F.col("rest.n_chars"))}
    return found.where("not contaminated").select(*_columns(docs, fields))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the text decoded from them, as digests, one row a document; a null text is empty."""
    return bpe.round_trip(docs, WORD_MODEL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("bpe encoding and decoding", encode),
]

#: No SQL engine expresses the classifier of the first stage or the merges of the last; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i}-{name.replace(' ', '-')}")
    return docs

"""From raw documents to training ids: language ID, near-dedup, mixing to weights, sentence pieces.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.  A document is a row: doc_id may be null or repeat with
another text.  Rows alike in doc_id and text are copies of one document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD
from ledgerloom.llm.language import UNKNOWN, fit, identify
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.near_dedup import near_duplicates, text_key
from ledgerloom.llm.sentence_pieces import Pieces, decode, default_model, encode
from ledgerloom.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; null text and text without letters go.  A missing lang takes the predicted one."""
    named = identify(docs.select(*COLUMNS), fit(docs))
    return named.where(F.col("lang_pred") != UNKNOWN).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, at a similarity of 0.8 or more: the one of smallest doc_id.

    Rows are known by doc_id and text.  A group without any doc_id keeps the row of smallest text key; of rows alike in
    doc_id and text the one of smallest lang, source and n_chars stays.  Rows without words are in no group and stay.
    """
    found = near_duplicates(docs, percent=80)
    standing = found.where("stands AND n_shingles > 0").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    keyed = docs.select(*COLUMNS, text_key(F.col("text")).alias("_text_key"))
    chosen = keyed.join(standing, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left_semi")
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = chosen.groupBy("doc_id", "_text_key").agg(F.min(F.struct(*rest, "text")).alias("one")).select("doc_id", "one.*").select(*COLUMNS)
    wordless = docs.where(~F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))).select(*COLUMNS)
    return one.unionByName(wordless)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and once more cut to the words left at a budget's end."""
    same = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in COLUMNS]))
    marked = docs.select(*COLUMNS, same.alias("_same"))
    takes = mix(marked, carry=("_same",)).groupBy("_same").agg(F.sum("taken").alias("_taken"), F.first("size").alias("_size"))
    taken = marked.dropDuplicates(["_same"]).join(takes.where("_taken > 0"), "_same")
    words = F.expr("IF(_size > 0, least(_size, _taken - (_copy - 1) * _size), 0)")
    copies = taken.withColumn("_copy", F.explode(F.expr("sequence(1, ceil(_taken / _size))"))).withColumn("_words", words)
    cut = F.expr(r"array_join(slice(split(text, '(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])'), 1, cast(_words AS int)), '')")
    text = F.when(F.col("_words") < F.col("_size"), cut).otherwise(F.col("text"))
    cut_now = copies.withColumn("text", text)
    length = F.when(F.col("_words") < F.col("_size"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut_now.withColumn("n_chars", length).select(*COLUMNS)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces, n_pieces and whether decoding gives the text back."""
    pieces = Pieces.load(default_model())
    return decode(encode(docs, pieces), pieces).select(
        "doc_id", "pieces", F.size("pieces").cast("long").alias("n_pieces"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("mixing", mix_sources), ("sentence pieces", sentence_pieces)]

#: No SQL: the first two stages learn or link beyond it.  Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage returns is kept in the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs

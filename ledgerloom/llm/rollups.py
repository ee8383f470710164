"""Token counts as rollups kept up by signed changes, with batches that commit once however often they are sent.

Method.  A batch holds, for documents and tokenizer versions, inserts, revised counts and deletes.  What a document
counted before is looked up in the committed entries; the batch's effect on the totals is the new entry less the old
one, under either's source and language, and only those signed sums are added to the rollup.  A batch writes its
entries, then its sums, then its commit, each to a folder of its own number, overwriting; readers look at committed
numbers alone.  So a batch that failed half-way is sent again, and one that is in already changes nothing.

Batches are numbered in order and sent in order.  In one batch the last change of a document and version (largest seq)
holds; of changes of one seq a delete holds, else the one with most tokens, then the last source and language.  A delete of what is not there counts nothing.  Null source or lang is a group of its own; a null count is 0; a
null doc_id cannot be looked up later, so commit raises an error on one; document_batches names such rows itself, so
that each counts as a document.  Repeated rows are one change.  An empty batch commits and adds nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable, word_count

KEY, GROUP = ["doc_id", "version"], ["source", "lang", "version"]
CHANGES = "doc_id long, version string, source string, lang string, tokens long, removed boolean, seq long"
_ENTRIES = "doc_id long, version string, source string, lang string, tokens long, removed boolean, batch long"
_SUMS = "source string, lang string, version string, documents long, tokens long, batch long"


class Rollup:
    """Totals by source, language and tokenizer version in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, frame: DataFrame, name: str, batch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def committed(self) -> DataFrame:
        return self._read("commits", "done boolean, batch long").select("batch").distinct()

    def entries(self) -> DataFrame:
        """The standing entry of every document and version, deletes among them."""
        rows = self._read("entries", _ENTRIES).join(self.committed(), "batch", "left_semi")
        return rows.groupBy(*KEY).agg(F.max_by(F.struct("source", "lang", "tokens", "removed"), "batch").alias("e")).select(*KEY, "e.*")

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens over the committed batches; groups without documents are left out."""
        rows = self._read("sums", _SUMS).join(self.committed(), "batch", "left_semi")
        sums = rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 OR tokens <> 0")

    def commit(self, changes: DataFrame, batch: int) -> bool:
        """Whether the batch was new.  changes: columns of CHANGES."""
        done = [r[0] for r in self.committed().where(F.col("batch") >= batch).collect()]
        if batch in done:
            return False
        if done:
            raise ValueError(f"batch {batch} comes after batch {max(done)}")
        named = changes.select(F.expr("IF(doc_id IS NULL, raise_error('a change without doc_id'), doc_id)").alias("doc_id"), "version", "source",
                               "lang", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("removed", F.lit(False)).alias("removed"), "seq")
        last = named.groupBy(*KEY).agg(F.max(F.struct("seq", "removed", "tokens", "source", "lang")).alias("e")).select(
            *KEY, "e.source", "e.lang", "e.tokens", "e.removed")
        self._write(last, "entries", batch)
        new = self.spark.read.parquet(f"{self.folder}/entries/batch={batch}")
        old = self.entries().join(new.select(*KEY), KEY, "left_semi")
        signed = new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1))).where("NOT removed")
        self._write(signed.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("documents"),
                                               F.sum(F.col("tokens") * F.col("sign")).alias("tokens")), "sums", batch)
        self._write(self.spark.createDataFrame([(True,)], "done boolean"), "commits", batch)
        return True


def document_batches(docs: DataFrame) -> list[DataFrame]:
    """Three batches of changes from documents: provisional counts, true counts, and the copies taken out again.

    Versions: `words` (first a sixth of n_chars, then the words counted) and `quads` (bytes by four, rounded up).
    A row without doc_id takes a key from 2**62 on: a hash of its columns and of how many rows like it came before.
    """
    columns = [c for c in docs.columns if c != "doc_id"]
    alike = docs.where("doc_id IS NULL").groupBy(*columns).agg(F.count("*").alias("_rows"))
    each = alike.withColumn("_place", F.explode(F.expr("sequence(1L, _rows)")))
    key = F.xxhash64(*columns, "_place").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    named = docs.where("doc_id IS NOT NULL").select("doc_id", *columns).union(each.select(key.alias("doc_id"), *columns))
    slim = named.select(
        "doc_id", "source", "lang", F.coalesce(F.floor(F.col("n_chars") / 6), F.lit(0)).cast("long").alias("guess"),
        F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).cast("long").alias("quads"),
        word_count(F.col("text")).alias("words"), F.sha2(F.col("text"), 256).alias("sha"))
    slim = durable(slim)

    def changes(frame, version, tokens, removed=False, seq=0):
        return frame.select("doc_id", F.lit(version).alias("version"), "source", "lang", F.col(tokens).alias("tokens"),
                            F.lit(removed).alias("removed"), F.lit(seq).cast("long").alias("seq"))

    firsts = slim.where("sha IS NOT NULL").groupBy(F.col("sha").alias("same")).agg(F.min("doc_id").alias("first_id"))
    copies = slim.join(firsts, (F.col("sha") == F.col("same")) & (F.col("doc_id") > F.col("first_id")))
    return [changes(slim, "words", "guess").union(changes(slim, "quads", "quads")), changes(slim, "words", "words"),
            changes(copies, "words", "words", True).union(changes(copies, "quads", "quads", True))]


ORACLE = r"""
WITH kept AS (
    SELECT d.* FROM documents d
    WHERE d.doc_id IS NOT NULL
      AND (d.text IS NULL OR d.doc_id = (SELECT min(e.doc_id) FROM documents e WHERE e.text = d.text))),
counted AS (
    SELECT source, lang, 'words' AS version,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n FROM kept
    UNION ALL
    SELECT source, lang, 'quads', ((coalesce(strlen(text), 0) + 3) // 4)::BIGINT FROM kept)
SELECT source, lang, version, count(*) AS documents, sum(n)::BIGINT AS tokens FROM counted GROUP BY source, lang, version
"""

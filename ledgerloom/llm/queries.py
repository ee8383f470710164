"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.llm import conversation_trie, mixing, rollups, secrets
from ledgerloom.llm.common import table
from ledgerloom.llm.exact_search import top_k
from ledgerloom.llm.language import language_of_documents
from ledgerloom.llm.licences import scan
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.multi_index import neighbours
from ledgerloom.llm.near_dedup import near_duplicates
from ledgerloom.llm.scoring import score_documents
from ledgerloom.llm.sentence_pieces import Pieces, decode, default_model, encode
from ledgerloom.llm.sharding import resharded_files
from ledgerloom.llm.whitening import whitened_components
from ledgerloom.session import ensure_checkpoint_dir


def op1_exact_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"))


def op2_multi_index(spark, sf_dir):
    return neighbours(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"))


def op3_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))


def op5_sentence_pieces(spark, sf_dir):
    pieces = Pieces.load(default_model())
    encoded = decode(encode(table(spark, sf_dir, "documents"), pieces), pieces)
    return encoded.select("doc_id", "pieces", F.size("pieces").cast("long").alias("n_pieces"),
                          F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op6_language_id(spark, sf_dir):
    return language_of_documents(table(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "stands")


def op9_token_rollup(spark, sf_dir):
    rollup = rollups.Rollup(spark, f"{ensure_checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}")
    batches = rollups.document_batches(table(spark, sf_dir, "documents"))
    for number in (1, 2, 2, 3):  # the second is sent twice and counts once
        rollup.commit(batches[number - 1], number)
    return rollup.totals()


def op10_sharding(spark, sf_dir):
    return resharded_files(table(spark, sf_dir, "documents"), f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}")


def op11_conversation_trie(spark, sf_dir):
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def op12_secret_scan(spark, sf_dir):
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark, sf_dir):
    return whitened_components(table(spark, sf_dir, "embeddings"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_exact_top_k, op2_multi_index, op3_mixing, op4_lm_scoring, op5_sentence_pieces, op6_language_id, op7_license_scan,
                                    op8_near_dedup, op9_token_rollup, op10_sharding, op11_conversation_trie, op12_secret_scan, op13_embedding_whitening, pipeline)}

ORACLE = {"op3_mixing": mixing.oracle(), "op9_token_rollup": rollups.ORACLE, "op11_conversation_trie": conversation_trie.ORACLE, "op12_secret_scan": secrets.oracle()}

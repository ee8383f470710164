"""The corpus pipeline, stage by stage and as a whole."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import corpus_pipeline as pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, "src0", None), (9002, "12 !! 34", None, "src0", 8), (None, "the of and to in", "en", "src1", 16)],
                                  docs.schema)
    docs = docs.union(extra)
    first = pipeline.language_id(spark, docs, SF)
    assert first.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in first.collect()} == {9001, 9002}
    first = spark.createDataFrame(first.collect(), docs.schema)
    second = pipeline.near_dedup(spark, first, SF)
    rows = [(r.doc_id, r.text) for r in first.collect() if r.doc_id is not None]
    groups = brute.near_duplicate_groups(rows, 80)
    kept = {r.doc_id for r in second.collect()}
    assert kept == {i for i, (_, root) in groups.items() if i == root} | {None}
    second = spark.createDataFrame(second.collect(), docs.schema)
    third = pipeline.mix_sources(spark, second, SF).collect()
    before = {r.doc_id: r for r in second.collect()}
    taken = {}
    for r in third:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(brute.words(r.text))
        assert before[r.doc_id].text.startswith(r.text)
    expected = {r.doc_id: r.taken for r in pipeline.mix(second).collect() if r.taken}
    assert taken == expected
    last = pipeline.sentence_pieces(spark, spark.createDataFrame(third, docs.schema), SF).collect()
    assert len(last) == len(third) and all(r.round_trip for r in last)


def test_run(spark):
    got = pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "pieces", "n_pieces", "round_trip"] and got.count() > 100


def test_near_dedup_of_rows_without_id_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(200)]
    text, near, other = " ".join(words), " ".join(words[:-1]), " ".join(reversed(words))
    rows = [(None, text, "en", "a", 1), (None, near, "en", "b", 2), (None, text, "en", "a", 1), (5, other, "en", "a", 3), (5, other, "de", "a", 3),
            (5, "another text of the same id here", "en", "a", 4), (6, other + " end", "en", "a", 5), (None, "alone in this table it is", "en", "a", 6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, at long, node string, stands int"
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], schema)
    got = sorted((str(r.doc_id), r.text[:9], r.lang) for r in pipeline.near_dedup(spark, docs, SF).collect())
    smaller = min((text, near), key=lambda t: spark.range(1).select(pipeline.text_key(pipeline.F.lit(t))).first()[0])
    assert got == sorted([("5", other[:9], "de"), ("5", "another t", "en"), ("None", smaller[:9], "en"), ("None", "alone in ", "en")])
    assert pipeline.near_dedup(spark, docs, SF).count() == 4


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, size long, block int")
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0

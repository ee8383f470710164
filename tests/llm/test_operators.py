"""The training-data operators on small inputs: brute force, hard rows, empty tables."""

import math
import sys
import zlib
from collections import Counter
from itertools import product
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from ledgerloom.llm import licences, rollups  # noqa: E402
from ledgerloom.llm.components import components  # noqa: E402
from ledgerloom.llm.exact_search import top_k  # noqa: E402
from ledgerloom.llm.language import language_of_documents  # noqa: E402
from ledgerloom.llm.mixing import mix, source_targets  # noqa: E402
from ledgerloom.llm.multi_index import neighbours  # noqa: E402
from ledgerloom.llm.near_dedup import near_duplicates  # noqa: E402
from ledgerloom.llm.scoring import (  # noqa: E402
    Lexicon, Spelling, hashes_of, learned_online, leanings, prefix_code, score_documents, sign_chances, spelled_words, word_experts)
from ledgerloom.llm.sentence_pieces import Pieces, decode, default_model, encode, segmented  # noqa: E402
from ledgerloom.llm.sharding import cheapest_transfers, reshard, resharded_files, rewrite_affected  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, score double, block int"
LONG = " ".join(f"w{i}" for i in range(30_000))
HARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", None, 3), (4, "One two", "fr", "b", 7),
    (5, "one TWO", "fr", "b", 7), (6, LONG, "en", "a", len(LONG)), (7, LONG + " tail", "en", "a", len(LONG) + 5),
    (8, "x" * 5000, "de", "c", 5000), (9, "12 34 !!", "de", "c", 8), (9, "12 34 !!", "de", "c", 8),
    (None, "no id here at all my friend", "en", "a", 27), (10, "é漢 ▁ \r\n  😀 ok", "es", "é", 15),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(*row, 1, "n", 0.5, 2) for row in HARD], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double, rank int")


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (98, 100), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[99] == got[98] == 98


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_brute_force(spark, percent):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    base = [f"t{i}" for i in range(60)]
    for k in range(80):  # a family whose members differ in one or two words each, around the threshold
        own = list(base)
        own[(7 * k) % 60] = f"x{k % 9}"
        if k % 2:
            own[(11 * k) % 60] = f"y{k}"
        rows.append((10_000 + k, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute.near_duplicate_groups(rows, percent)
    # Small regions and families, so that deep regions and block pairs are used.
    got = near_duplicates(frame, percent, region_rows=16, family_rows=16).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_without_or_with_repeated_ids(spark):
    w = [f"t{i}" for i in range(60)]
    a, bridge, c = w, [*w[:-4], "x1", "x2", "x3", "x4"], ["y1", "y2", "y3", "y4", *w[4:-4], "x1", "x2", "x3", "x4"]
    z = [f"z{i}" for i in range(60)]
    rows = [(1, a), (None, bridge), (None, bridge), (2, c), (None, z), (None, [*z[:-1], "end"]),
            (7, [f"q{i}" for i in range(60)]), (7, [f"r{i}" for i in range(60)]), (8, [*[f"r{i}" for i in range(59)], "end"])]
    got = near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()
    # 1 and 2 are linked only through the rows without id.
    one, other = brute.shingle_set(" ".join(a)), brute.shingle_set(" ".join(c))
    assert len(one & other) < 0.85 * len(one | other)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (2, 1), (7, 7), (7, 7), (8, 7)]
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["1", "1", "None", "None"]


def test_near_duplicates_hard_rows(hard, nothing):
    got = near_duplicates(hard).collect()
    assert len(got) == len(HARD)
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].component_id == 4 and by_id[7].component_id == 6
    assert [by_id[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and by_id[3].kept
    assert near_duplicates(nothing).count() == 0


def unit(n, d=16, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, d))
    x[n // 2:] = x[n // 2] + 0.01 * x[n // 2:]  # half of the rows lie close together
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_exact_search_against_brute_force(spark):
    x = unit(600).astype(np.float32)
    x[500:540] = x[500]  # ties
    frame = vectors(spark, [(i, v.tolist(), 0, 0.0, 1) for i, v in enumerate(x)])
    got = top_k(frame, F.expr("vec_id % 20 = 0"), k=20, shard_rows=150, query_rows=10, leaf_rows=16).collect()
    y = np.floor(64 * x.astype(float))
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in range(0, 600, 20):
        s = y @ y[q]
        order = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        assert [found[q][k + 1] for k in range(20)] == [(i, int(s[i])) for i in order]


def test_multi_index_recall(spark):
    x = unit(1500)
    frame = vectors(spark, [(i, v.tolist(), 0, 0.0, 1) for i, v in enumerate(x)])
    got = neighbours(frame, F.expr("vec_id % 20 = 0"), shard_rows=800, query_rows=40).toPandas()
    x = np.array(frame.select("embedding").toPandas()["embedding"].tolist())
    hits = 0
    for q, rows in got.groupby("query_id"):
        s = x @ x[q]
        assert np.allclose(rows["score"], s[rows["vec_id"]], atol=1e-12) and q not in set(rows["vec_id"])
        s[q] = -9
        hits += (rows["score"] >= np.sort(s)[-20] - 1e-12).sum()
    assert hits / (75 * 20) >= 0.9


@pytest.mark.parametrize("search", [top_k, neighbours])
def test_search_hard_rows(spark, search):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.5, 0.5]), (40, None), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]),
            (100, [None, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (120, [1.0, 2.0, 3.0]), (140, [])]
    frame = vectors(spark, [(*r, 0, 0.0, 1) for r in rows])
    got = {(r.query_id, r["rank"]): r.vec_id for r in search(frame, F.expr("vec_id % 20 = 0")).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (0, 3): 20, (20, 1): 1, (20, 2): 2, (20, 3): 0}
    assert search(vectors(spark, []), F.expr("vec_id % 20 = 0")).count() == 0


def test_mixing(spark, documents, hard, nothing):
    rows = mix(documents).toPandas()
    by_source = documents.select("doc_id", "source").toPandas().merge(rows, on="doc_id").groupby("source", dropna=False)
    for _, own in by_source:
        assert own["taken"].sum() == math.floor(own["target"].iloc[0] + 0.5)
    assert (rows["taken"] <= 3 * rows["size"]).all()
    assert sorted(mix(documents).collect()) == sorted(mix(documents).collect())
    got = mix(hard).collect()
    assert len(got) == len(HARD) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert mix(nothing).count() == 0


def test_targets_reshare_what_stops(spark):
    sizes = {"a": 10, "b": 1000, "c": 5000, "d": 0, None: 100}
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    target, fixed = {}, {}
    while True:  # the rule word for word
        left = sum(sizes.values()) - sum(fixed.values())
        free = {s: w for s, w in weight.items() if s not in fixed}
        target = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = {s: 3.0 * sizes[s] for s, t in target.items() if t > 3 * sizes[s]}
        if not over:
            break
        fixed |= over
    assert got == pytest.approx(fixed | target)


def test_scoring(spark, documents, hard, nothing):
    rows = {r.doc_id: r for r in score_documents(documents, table_bits=16).collect()}
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    counts = Counter()
    for i, text in texts:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*brute.words(text), b""])
    n, v = sum(counts.values()), len(counts)
    held = [0.0, 0.0]
    for i, text in texts:
        tokens = [*brute.words(text), b""]
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
        assert r.score < 0 and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        if r.held_out:
            held[0] += r.base_score
            held[1] += r.score
    assert held[1] > held[0]
    got = score_documents(hard, table_bits=16).collect()
    assert len(got) == len(HARD) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[1] == 1
    assert score_documents(nothing, table_bits=16).count() == 0


def test_bits_per_byte_is_a_code_length(spark, documents):
    letters = np.random.default_rng(3).integers(97, 123, (100, 40), dtype=np.uint8)
    text = " ".join(bytes(w).decode() for w in letters)
    i = next(i for i in range(50_000, 60_000) if zlib.crc32(str(i).encode()) % 5 == 1)
    more = spark.createDataFrame([(i, text)], "doc_id long, text string")
    got = score_documents(documents.select("doc_id", "text").union(more), table_bits=16).where(f"doc_id = {i}").first()
    # Random letters: no code of the words can be shorter than they are many.
    assert got.n_known == 1 and got.bits_per_byte * len(text) > 0.95 * letters.size * math.log2(26)


def test_mixed_contexts_alone_beat_an_order_1_spelling(spark, documents):
    counts, held = Counter(), set()
    for r in documents.collect():
        own = [*brute.words(r.text), b""]
        held.update(own) if zlib.crc32(str(r.doc_id).encode()) % 5 == 1 else counts.update(own)
    words = [(bytearray(w), counts[w]) for w in sorted(held | set(counts))]
    costs = spelled_words(spark.createDataFrame(words, "word binary, c long"), 16).collect()
    after, pairs = Counter(), Counter()
    for w, c in counts.items():
        for a, b in zip(b" " + w, w + b" ", strict=True):
            after[a] += c
            pairs[a, b] += c
    mixed = sum(r.cost for r in costs if not r.c)
    plain = -sum(math.log10((pairs[a, b] + 0.1) / (after[a] + 25.6)) for r in costs if not r.c
                 for a, b in zip(b" " + bytes(r.word), bytes(r.word) + b" ", strict=True))
    assert mixed < 0.9 * plain
    known = np.array([(r.c, -r.cost) for r in costs if r.c])
    heard = float((10 ** known[:, 1]).sum())
    # One word of no count stands for all others: every expert's chances add up to one.
    c, spelled = np.r_[known[:, 0], 0], np.r_[known[:, 1], -5]
    _, classed = word_experts(c, spelled, sum(counts.values()), len(counts), sum(x == 1 for x in counts.values()), heard)
    assert [float((10 ** e).sum()) for e in classed] == pytest.approx([1, 1, 1])


def test_words_are_scored_in_their_order(spark):
    # Every training text counts up; the words alone cannot tell a text that does so from one that does not.
    names = [f"w{k}" for k in range(12)]
    train, held = ([i for i in range(900) if (zlib.crc32(str(i).encode()) % 5 == 1) == out] for out in (False, True))
    rows = [(i, " ".join(names[(i + k) % 12] for k in range(8))) for i in train]
    rows += [(held[0], " ".join(names[:8])), (held[1], " ".join(names[k] for k in (3, 0, 6, 1, 7, 4, 2, 5)))]
    got = {r.doc_id: r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string"), table_bits=16).collect()}
    up, mixed = got[held[0]], got[held[1]]
    assert up.base_score == pytest.approx(mixed.base_score)
    assert up.score > mixed.score + 4 and up.bits_per_byte < mixed.bits_per_byte


def test_chances_of_all_signs_after_words_add_up_to_one():
    words = [f"v{k}".encode() for k in range(13)]
    lexicon = Lexicon(words, np.arange(13, 0, -1), 100, 12, endings=1)
    text = " ".join(f"v{(k * k) % 14}" for k in range(4000))
    counts, mixer, total = learned_online(iter([pa.array([text, None, ""])]), lexicon, 12)
    again = learned_online(iter([pa.array([" ".join(text.split()[::-1]), None, ""])]), lexicon, 12)
    # Learned online: the order of the words moves the weights, which have left where they began.
    assert total == 4003 and not np.allclose(mixer.weights, again[1].weights) and not np.allclose(mixer.weights, 0.3)
    assert counts.sum() == 4 * lexicon.code[1][lexicon.signs(hashes_of([*(f"v{(k * k) % 14}".encode() for k in range(4000)), b"", b"", b""]))].sum()
    # Each of the own words, the one of an ending, and one that is not known.
    after = np.concatenate([hashes_of([b"v1", b"v4", w]) for w in [*words, b"unknown"]])
    found = sign_chances(after, np.arange(0, len(after) + 1, 3), lexicon, leanings(counts.astype(np.float32)), mixer)
    assert (10 ** found[2::3]).sum() == pytest.approx(1)
    assert Lexicon([], np.zeros(0), 0, 4).signs(hashes_of([b"a"])).tolist() == [36]


def test_a_context_holds_the_whole_word_so_far():
    # Alike in their last five bytes, so that only the whole word so far tells the two ends apart; the last word repeats.
    spelling = Spelling([b"abcdefgh", b"xyzdefgh", b"abcdefgh"], prefix_code([1.0] * 256))
    assert spelling.sign[8] == spelling.sign[17] == 32
    assert [bool(c[8] != c[17]) for c in spelling.contexts] == [False, False, False, False, True]
    assert all((c[:9] == c[18:]).all() for c in spelling.contexts)


def test_prefix_code_is_complete():
    bits, length = prefix_code([float(i % 7) for i in range(256)])
    assert sum(2.0 ** -n for n in length) == pytest.approx(1)
    assert len({(int(b), int(n)) for b, n in zip(bits, length, strict=True)}) == 256


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load(default_model())


def test_pieces_equal_the_library_and_decode_back(spark, documents, hard, nothing, pieces):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    extra = [(10_000 + i, t) for i, t in enumerate(["a  b", " lead", "trail  ", "\n\n", "zzz" * 40, "Ünïcödé 漢字", "a" * 300])]
    frame = documents.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    for r in decode(encode(frame, pieces), pieces).collect():
        assert r.pieces == library.encode(r.text) and r.decoded == r.text
    got = decode(encode(hard, pieces), pieces).collect()
    assert len(got) == len(HARD)
    for r in got:
        assert r.pieces is None if r.text is None else r.pieces == library.encode(r.text)
    assert decode(encode(nothing, pieces), pieces).count() == 0


def test_viterbi_for_unigram_tables(spark):
    names = {"▁": -3.0, "▁a": -2.0, "a": -2.5, "b": -2.0, "ab": -3.0, "ba": -1.5, "aba": -4.0}
    table = Pieces({p: i for i, p in enumerate(names)}, list(names.values()), [9] * 256, 9, False, [p.encode() for p in names] + [b""] * 3)
    words = ["▁abab", "▁bab", "▁aba", "▁b?a"]
    frame = spark.createDataFrame([(w, 0, [1]) for w in words], "word string, range int, places array<int>").repartition(2, "word", "range")
    got = {r.word: r.ids for r in segmented(frame, table, ["word", "range"], "places").collect()}
    worst = min(names.values()) - 10

    def best(word):
        found = []
        for cuts in product([0, 1], repeat=len(word) - 1):
            parts, part = [], word[0]
            for c, ch in zip(cuts, word[1:], strict=True):
                if c:
                    parts.append(part)
                    part = ch
                else:
                    part += ch
            parts.append(part)
            if all(p in names or len(p) == 1 for p in parts):
                found.append((sum(names.get(p, worst) for p in parts), parts))
        return max(found)[0]

    for w in words:
        ids = got[w]
        total = sum(table.scores[i] if i >= 0 else worst for i in ids)
        assert total == pytest.approx(best(w))


def test_language(spark, hard, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "lang").toPandas().merge(language_of_documents(docs, 100).toPandas(), on="doc_id")
    held = rows[rows["held_out"]]
    assert len(rows) == 1000 and (held["lang"] == held["lang_pred"]).mean() >= 0.97
    assert rows["score"].between(0, 1).all()
    got = language_of_documents(hard, 10).collect()
    assert len(got) == len(HARD)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 9)} == {"und"}
    assert language_of_documents(nothing).count() == 0


def test_licences(spark, hard, nothing):
    filler = " ".join(f"f{i}" for i in range(500))
    long = licences.TEMPLATES["MIT-text"]
    docs = spark.createDataFrame([(1, f"{filler} {long} {filler}"), (2, f"{filler} Released under the MIT License. {filler}"), (3, filler),
                                  (4, "licensed under the Apache"), (5, "# " + long.upper().replace(" ", "\n# "))], "doc_id long, text string")
    got = {(r.doc_id, r.template): r.containment for r in licences.scan(docs).collect()}
    assert got == {(1, "MIT-text"): 1.0, (2, "MIT"): 1.0, (5, "MIT-text"): 1.0}
    assert licences.scan(hard).count() == 0 and licences.scan(nothing).count() == 0


def test_licences_against_exact_containment(documents):
    import re

    def runs(text):
        w = [x for x in re.split("[^a-z0-9]+", (text or "").lower()) if x]
        return {tuple(w[i:i + 3]) for i in range(len(w) - 2)}

    short = {n: t for n, t in licences.TEMPLATES.items() if len(runs(t)) <= 32}
    expected = {(d.doc_id, n) for d in documents.collect() for n, t in short.items() if len(runs(t) & runs(d.text)) >= 0.8 * len(runs(t))}
    assert {(r.doc_id, r.template) for r in licences.scan(documents, short).collect()} == expected


def test_rollup_is_idempotent_and_signed(spark, tmp_path):
    rollup = rollups.Rollup(spark, str(tmp_path / "r"))

    def batch(*rows):
        return spark.createDataFrame(list(rows), rollups.CHANGES)

    assert rollup.commit(batch((1, "v", "s", "en", 10, False, 0), (2, "v", "s", None, 5, False, 0), (2, "v", "s", None, 5, False, 0)), 1)
    assert not rollup.commit(batch((1, "v", "s", "en", 99, False, 0)), 1)
    assert rollup.commit(batch((1, "v", "t", "en", 4, False, 0), (1, "v", "t", "en", 7, False, 1), (2, "v", "s", None, None, True, 0), (3, "v", "s", "en", 1, True, 0)), 2)
    assert {tuple(r) for r in rollup.totals().collect()} == {("t", "en", "v", 1, 7)}
    assert rollup.commit(batch(), 3) and rollup.totals().count() == 1
    with pytest.raises(ValueError):
        rollup.commit(batch((4, "v", "s", "en", 1, False, 0)), 0)


def test_document_batches_count_rows_without_id(spark, tmp_path):
    rows = [(1, "one two", "en", "s", 7), (2, "one two", "en", "s", 7), (None, "one two", "en", "s", 7),
            (None, "three four five", "en", "s", 15), (None, None, "fr", "s", None), (None, None, "fr", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    rollup = rollups.Rollup(spark, str(tmp_path / "r"))
    batches = rollups.document_batches(docs)
    for number in (1, 2):
        rollup.commit(batches[number - 1], number)
    assert {tuple(r) for r in rollup.totals().where("version = 'words'").collect()} == {("s", "en", "words", 4, 9), ("s", "fr", "words", 2, 0)}
    rollup.commit(batches[2], 3)  # the copies of the first text go, with or without id
    assert {tuple(r) for r in rollup.totals().where("version = 'words'").collect()} == {("s", "en", "words", 2, 5), ("s", "fr", "words", 2, 0)}


def test_transfers_move_the_fewest_bytes():
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(0, 1000, 12)]
    share, over = divmod(sum(sizes), 16)
    room = [share + (j < over) for j in range(16)]
    flow = cheapest_transfers(sizes, room)
    assert [sum(x for (i, _), x in flow.items() if i == k) for k in range(12)] == sizes
    assert sum(x for (i, j), x in flow.items() if i != j) == sum(max(0, s - room[i]) for i, s in enumerate(sizes))
    far = cheapest_transfers([10, 0], [0, 5, 5], cost=lambda i, j: abs(i - j))
    assert far == {(0, 1): 5, (0, 2): 5}


def test_resharding(spark, documents, hard, nothing, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = reshard(docs).toPandas()
    by_shard = rows.groupby("shard")
    assert len(rows) == 1000 and sorted(by_shard.groups) == list(range(40))
    assert all(sorted(own["slot"]) == list(range(len(own))) for _, own in by_shard)
    spread = by_shard["size"].sum()
    assert spread.max() - spread.min() <= 4 * rows["size"].max()
    assert all(r.text_crc32 == zlib.crc32(r.text.encode()) and r["size"] == len(r.text.encode()) + 16
               for r in reshard(docs).join(docs.select("doc_id", "text"), "doc_id").collect()[:200])
    got = reshard(hard).collect()
    assert len(got) == len(HARD) and {r["size"] for r in got if r.doc_id == 1} == {16}
    assert reshard(nothing).count() == 0
    folder = str(tmp_path / "shards")
    touched = rewrite_affected(docs, reshard(docs), folder)
    written = spark.read.parquet(folder)
    assert {r[0] for r in written.select("shard").distinct().collect()} <= set(touched)
    assert written.count() == rows["shard"].isin(touched).sum()


def test_rewrite_keeps_rows_without_id_and_repeats(spark, tmp_path):
    texts = [(None if i % 3 else i % 7, f"text number {i % 40} " * (i % 5), None, "abc"[i % 3], i) for i in range(300)]
    docs = spark.createDataFrame([(*t, 1, "n", 0.5, 2) for t in texts], DOCS)
    assigned = reshard(docs, shards=4)
    touched = rewrite_affected(docs, assigned, str(tmp_path / "s"))
    written = spark.read.parquet(str(tmp_path / "s"))
    wanted = assigned.where(F.col("shard").isin(touched))
    assert written.count() == wanted.count() > 0
    got = sorted((r.shard, r.slot, str(r.doc_id), zlib.crc32(r.text.encode()), len(r.text.encode()) + 16) for r in written.collect())
    assert got == sorted((r.shard, r.slot, str(r.doc_id), r.text_crc32, r.size) for r in wanted.collect())
    assert sorted(r.n_chars for r in written.collect()) == sorted(set(r.n_chars for r in written.collect()))


def test_files_read_back_are_the_assignment(spark, tmp_path, hard, nothing):
    texts = [(None if i % 3 else i % 7, f"text number {i % 40} " * (i % 5), None, "abc"[i % 3], i) for i in range(300)]
    texts += [(None, "one row many times", "en", "a", 18)] * 9000
    docs = spark.createDataFrame([(*t, 1, "n", 0.5, 2) for t in texts], DOCS).withColumn("shard", F.lit("clash")).withColumn("_id", F.lit(1))
    shape = ["doc_id", "size", "text_crc32", "shard", "slot", "old_shard"]
    got = resharded_files(docs, str(tmp_path / "s")).select(*shape).toPandas()
    assert len(got) == len(texts) and not got.duplicated(["shard", "slot"]).any()
    # The same rows with the same copies: each of the input's, as often as it is there.
    count = Counter((t[0], len(t[1].encode()) + 16, zlib.crc32(t[1].encode())) for t in texts)
    assert Counter((None if math.isnan(i) else int(i), z, c) for i, z, c in zip(got["doc_id"], got["size"], got["text_crc32"], strict=True)) == count
    assert all(sorted(own["slot"]) == list(range(len(own))) for _, own in got.groupby("shard"))
    spread = got.groupby("shard")["size"].sum()
    assert spread.max() - spread.min() <= 6 * got["size"].max()
    again = resharded_files(docs.repartition(7), str(tmp_path / "again")).select(*shape).toPandas()
    order = ["shard", "slot"]
    assert got.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    assert resharded_files(hard, str(tmp_path / "hard")).count() == len(HARD)
    assert resharded_files(nothing, str(tmp_path / "none")).count() == 0


def test_unigram_words_over_sixty_characters(spark):
    names = {"▁": -3.0, "▁a": -2.0, "a": -2.5, "b": -2.0, "ab": -3.0, "ba": -1.5, "aba": -4.0}
    table = Pieces({p: i for i, p in enumerate(names)}, list(names.values()), [9] * 256, 9, False, [p.encode() for p in names] + [b""] * 3)
    strange = 10 - min(names.values())
    for word in ["ab" * 39, "abba" * 17 + "?" + "ba" * 4, "a" * 61]:
        marked = "▁" + word
        cost = [0.0]
        for end in range(1, len(marked) + 1):
            ways = [cost[s] - names[marked[s:end]] for s in range(end) if marked[s:end] in names]
            cost.append(min(ways) if ways else cost[end - 1] + strange)
        docs = spark.createDataFrame([(1, word), (2, "ab " + word[:59])], "doc_id long, text string")
        got = {r.doc_id: r.pieces for r in encode(docs, table).collect()}
        spent = sum(-list(names.values())[i] if i != 9 else strange for i in got[1])
        assert math.isclose(spent, cost[-1]) and got[1] == table.best_path(marked)
        assert got[2] == table.best_path("▁ab") + table.best_path("▁" + word[:59])


def test_language_sample_is_bounded(spark):
    from ledgerloom.llm import language

    words = ["the cat and dog", "und der hund ist", "le chat et la"]
    rows = [(None, f"{words[i % 3]} {i}", "edf"[i % 3]) for i in range(3000)] + [(7, "the same id and text", "e")] * 2000
    rows += [(7, f"one id and text {i}", "e") for i in range(500)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = {r.lang: r.n for r in language._sampled(labelled, 50, 512).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert set(drawn) == set("edf") and all(20 <= n <= 100 for n in drawn.values())
    assert {r.lang for r in language._sampled(labelled, 50, 2).select("lang").distinct().collect()} == {"e", "d"}
    assert sorted(map(tuple, language._sampled(labelled, 50, 512).collect()), key=str) == sorted(
        map(tuple, language._sampled(labelled.repartition(7), 50, 512).collect()), key=str)


def test_rollup_ties_and_order_of_rows(spark, tmp_path):
    rows = [(1, "v", "s", "en", 3, False, 0), (1, "v", "t", "fr", 2, False, 0), (2, "v", None, None, 5, False, 0), (2, "v", "a", "en", 5, True, 0)]
    for name, order in (("a", rows), ("b", rows[::-1])):
        rollup = rollups.Rollup(spark, str(tmp_path / name))
        assert rollup.commit(spark.createDataFrame(order, rollups.CHANGES).coalesce(1), 1)
        assert {tuple(r) for r in rollup.totals().collect()} == {("s", "en", "v", 1, 3)}

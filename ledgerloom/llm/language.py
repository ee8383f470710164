"""Language of a text, by hierarchical discrimination: the family first, then one-versus-one machines within it.

Method.  A text is a vector of square-rooted counts of hashed byte pairs and triples of its lower-cased letters, over
the whole text, at length one.  Families are learned, by joining the languages whose mean vectors are closest until half as
many families are left.  A softmax over linear scores picks the family; inside it, linear support vector machines,
one for each pair of languages, vote.  The score is the family's probability times the winner's mean share of its
pairwise decisions.

Fitted on a bounded sample of labelled rows: about `per_language` rows of each language, those of smallest hash, so
that the driver holds languages * per_language vectors at most.  Prediction reads the text alone, needs no shuffle and
works on every row.

Null text, or text without letters: `und`, score 0.  Nothing to learn from: `und` for all.  Rows with null lang teach
nothing.  Very long texts are cut nowhere.  Repeated rows get equal answers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm.wordhash import pieces, text_bytes

SAMPLE_SEED = 29
UNKNOWN = "und"
WIDTH = 4096
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint32)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(column: pa.Array) -> np.ndarray:
    """One row of WIDTH numbers for each text."""
    raw, at = text_bytes(column)
    out = np.zeros((len(at) - 1, WIDTH), np.float32)
    for i in range(len(at) - 1):
        letters = _FOLD[raw[at[i]:at[i + 1]]]
        pairs = letters[:-1] * np.uint32(257) + letters[1:]
        triples = pairs[:-1] * np.uint32(65_599) + letters[2:]
        for grams in (pairs, triples):
            slot = (grams * np.uint32(2_654_435_761)) >> np.uint32(20)
            out[i] += np.bincount(slot, minlength=WIDTH)
    out = np.sqrt(out)
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.maximum(length, 1e-9)


@dataclass
class Model:
    """families: languages of each; family_lines: a line of weights and a bias each; duels: (one, other) -> the same."""

    families: list[list[str]]
    family_lines: np.ndarray
    duels: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        logits = 12 * (x @ self.family_lines)
        share = np.exp(logits - logits.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        won = share.argmax(1)
        names, scores = np.empty(len(x), object), share.max(1).astype(float)
        for f, family in enumerate(self.families):
            rows = np.flatnonzero(won == f)
            if not len(rows):
                continue
            votes, sure = np.zeros((len(rows), len(family))), np.zeros((len(rows), len(family)))
            for a, b in combinations(range(len(family)), 2):
                margin = np.clip(x[rows] @ self.duels[(family[a], family[b])], -20, 20)
                chance = 1 / (1 + np.exp(-3 * margin))
                votes[:, a] += margin >= 0
                votes[:, b] += margin < 0
                sure[:, a] += chance
                sure[:, b] += 1 - chance
            best = (votes + sure / (len(family) + 1)).argmax(1)
            names[rows] = [family[b] for b in best]
            if len(family) > 1:
                scores[rows] *= sure[np.arange(len(rows)), best] / (len(family) - 1)
        return list(names), np.clip(scores, 0, 1)


def _machine(x: np.ndarray, sign: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """A linear support vector machine: the hinge loss, both sides of equal weight, by averaged subgradient steps."""
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    line, mean = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(rounds):
        inside = sign * (x @ line) < 1
        line += 20 / (1 + t / 20) * ((share * sign * inside) @ x - decay * line)
        mean += (line - mean) / (t + 1)
    return mean


def _families(centres: dict[str, np.ndarray]) -> list[list[str]]:
    groups = [[name] for name in sorted(centres)]
    wanted = -(-len(groups) // 2)
    while len(groups) > wanted:
        def close(pair):
            one, other = (np.mean([centres[n] for n in groups[k]], 0) for k in pair)
            return float(one @ other / (np.linalg.norm(one) * np.linalg.norm(other) + 1e-12))
        a, b = max(combinations(range(len(groups)), 2), key=close)
        groups[a] = sorted(groups[a] + groups.pop(b))
    return groups


def _sampled(labelled: DataFrame, per_language: int, most_languages: int) -> DataFrame:
    """doc_id, text, lang: about per_language different rows of each language and never more than twice that many.

    A row's place is a hash of all it has, so rows without id and rows of one id are drawn one by one.  Rows alike in id,
    text and language are one row.  Both windows see only what has passed the draw.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    usable = usable.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    usable = usable.withColumn("drawn", F.xxhash64(F.lit(SAMPLE_SEED), "doc_id", "text", "lang"))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("drawn").alias("rows")).orderBy(F.desc("rows"), "lang").limit(most_languages).collect()
    rows = [(r["lang"], int(min(1.0, per_language / max(1, r["rows"])) * (1 << 30)) + 1) for r in counts]
    limits = F.broadcast(usable.sparkSession.createDataFrame(rows, "lang string, below long"))  # most_languages rows
    passed = usable.join(limits, "lang").where(F.pmod("drawn", F.lit(1 << 30)) < F.col("below"))
    once = passed.groupBy("lang", "drawn").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("drawn", F.lit(1 << 30)), "drawn"))
    return once.withColumn("place", place).where(F.col("place") <= 2 * per_language).select("doc_id", "text", "lang")


def fit(labelled: DataFrame, per_language: int = 300, most_languages: int = 512) -> Model | None:
    """A model from rows (doc_id, text, lang) of the most frequent languages; None if there is nothing to learn from."""
    sample = _sampled(labelled, per_language, most_languages)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                lettered = [bool(_LETTER.search(t)) for t in part.column("text").to_pylist()]
                x = features(part.column("text")).astype(np.float16)
                keep = np.flatnonzero(lettered)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(keep)), part.column("lang").take(pa.array(keep)),
                    pa.array([x[i].tobytes() for i in keep], pa.binary())], ["doc_id", "lang", "x"])

    got = sample.mapInArrow(vectors, "doc_id string, lang string, x binary").orderBy("lang", "doc_id", "x").toArrow()
    if not got.num_rows:
        return None
    lang = np.array(got.column("lang").to_pylist(), object)
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float64)
    families = _families({name: x[lang == name].mean(0) for name in sorted(set(lang))})
    x = np.hstack([x, np.ones((len(x), 1))])
    of = {name: f for f, family in enumerate(families) for name in family}
    family = np.array([of[name] for name in lang])
    lines = [_machine(x, np.where(family == f, 1.0, -1.0)) if len(families) > 1 else np.zeros(WIDTH + 1)
             for f in range(len(families))]
    duels = {}
    for names in families:
        for one, other in combinations(names, 2):
            rows = (lang == one) | (lang == other)
            duels[(one, other)] = _machine(x[rows], np.where(lang[rows] == one, 1.0, -1.0))
    return Model(families, np.stack(lines, 1), duels)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and lang_score added (columns of those names are replaced); reads the column text alone."""
    docs = docs.drop("lang_pred", "lang_score")
    columns = docs.columns

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                names, scores = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                rows = np.array([i for i, t in enumerate(part.column("text").to_pylist()) if t and _LETTER.search(t)], int)
                if model is not None and len(rows):
                    names[rows], scores[rows] = model.predict(features(part.column("text").take(pa.array(rows))))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    [*columns, "lang_pred", "lang_score"])

    schema = StructType(list(docs.schema.fields)).add("lang_pred", "string").add("lang_score", "double")
    return docs.mapInArrow(predict, schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text falls in the fold; a null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_of_documents(docs: DataFrame, per_language: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out."""
    out = held_out(F.col("doc_id"), 4, 2)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"), out.alias("held_out"))
    model = fit(docs.where(~out), per_language)
    return identify(slim, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))

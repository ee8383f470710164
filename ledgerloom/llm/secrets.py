"""Secret scans: a trigram index finds the texts that a rule can match, its expression then verifies them.

Method.  Of every rule's regular expression the trigrams are derived that each match must hold (`trigrams.query_of`).
A task takes its rows in segments of bounded size and indexes each segment: trigram -> places of the texts that hold it.
The postings of a rule's trigrams are intersected, the alternatives united, and the expression runs over the candidates
alone.  A rule from which no trigram can be derived (a run of hexadecimal digits) scans every text of the segment.

Segments hold 8 MB of text, or one longer text, and are indexed 4 MB at a time.  Texts are read once and never
shuffled, so neither copies nor words that all documents share make a task larger; a lost task is computed again.
The postings are those of the rules' own trigrams, some hundred: an index of all trigrams would be larger than the texts.

Null text counts as empty, with no span; every row gives one row, also rows without doc_id and rows that repeat.  Spans
are in code points, the end exclusive, in order of start and then of the rules' order; those of two kinds may overlap.
Letters in either case mean A-Z and a-z alone.  No documents: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.trigrams import Segment, Vocabulary, query_of

SEGMENT_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  group: the part of a match (0: all of it) that must have `least` characters."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 1

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.any_case else 0)

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = self.compiled().finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)  # kept by re itself


# The three base rules, in the order in which their kinds are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
)
# Published forms of tokens, keys and credentials.
FURTHER = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,255}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,255}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]{2,10} ){0,3}PRIVATE KEY-----"),
    Rule("url", r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20/:@]{1,255}:[^\x00-\x20/:@]{1,255}@"),
)
RULES = BASE + FURTHER

SPANS = "array<struct<kind:string,start:long,end:long>>"


def _segments(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """Slices of a batch with their texts' bytes and offsets."""
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SEGMENT_BYTES, "right")) - 1)
        yield batch.slice(start, end - start), texts.slice(start, end - start), data, offsets[start:end + 1]
        start = end


def _scanner(rules: tuple[Rule, ...]):
    queries = [query_of(r.pattern, r.flags) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(queries)
        kinds = [r.kind for r in rules]
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            for part, own, data, offsets in _segments(batch, texts):
                segment = Segment(vocabulary, data, offsets)
                found: dict[int, list[tuple[int, int, int]]] = {}
                chosen = [segment.candidates(q) for q in queries]
                wanted = np.unique(np.concatenate(chosen)) if chosen else []
                by_rule = [set(c.tolist()) for c in chosen]
                for place in map(int, wanted):
                    text = own[place].as_py()
                    for k, rule in enumerate(rules):
                        if place in by_rule[k] and (spans := rule.spans(text)):
                            found.setdefault(place, []).extend((start, k, end) for start, end in spans)
                counts = np.zeros(len(own) + 1, np.int32)
                flat: list[tuple[int, int, int]] = []
                for place in sorted(found):
                    flat += sorted(found[place])
                    counts[place + 1] = len(found[place])
                spans = pa.StructArray.from_arrays(
                    [pa.array([kinds[k] for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int64()),
                     pa.array([e for _, _, e in flat], pa.int64())], ["kind", "start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), spans)], ["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (kind, start, end) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(_scanner(rules), f"doc_id long, spans {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of(kinds: list[str]) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(kinds))


def secret_digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    base = [r.kind for r in BASE]
    of_base = _of(base)
    counts = [F.size(_of([k])).cast("long").alias(f"n_{k}") for k in base]
    return find_secrets(docs, rules).select(
        "doc_id", *counts, F.sha2(listed(of_base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same rows in DuckDB's SQL: every expression over every text, spans from the lengths of pieces and matches."""

    def in_re2(rule: Rule) -> str:
        return (f"(?i){rule.pattern}" if rule.any_case else rule.pattern).replace("'", "''")

    kinds = []
    for place, rule in enumerate(rules):
        p = in_re2(rule)
        kinds.append(rf"""
    SELECT r, {place} AS k, '{rule.kind}' AS kind, s AS pos, s + length(m) AS fin FROM (
        SELECT r, ms[i] AS m,
               list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
        FROM (SELECT r, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
            SELECT r, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps FROM d WHERE regexp_matches(t, '{p}'))))
    WHERE length(regexp_extract(m, '{p}', {rule.group})) >= {rule.least}""")
    named = "kind || ':' || pos::BIGINT || ':' || fin::BIGINT"
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"(count(*) FILTER (kind = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(kinds)})
SELECT doc_id, {counts},
       sha256(coalesce(string_agg({named}, ',' ORDER BY pos, k) FILTER (kind IN ({base})), '')) AS base_sha256,
       coalesce(string_agg({named}, ',' ORDER BY pos, k) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN s ON d.r = s.r GROUP BY d.r, doc_id
"""

"""Encoding texts into SentencePiece ids and decoding them, over a relational lattice.

Method.  A text is cut into words no piece can cross: a run of spaces (each written as the meta sign) with what follows
it; a character that is a piece only by itself stands alone.  Each distinct word of a block is sent once.  Its
substrings of bounded length are exploded and equi-joined to the piece table; the edges found are grouped by word, and
Spark's higher-order `aggregate` folds them.  For unigram models the fold is Viterbi: the best score up to each place.
The public model in use is a byte-pair model, whose segmentation is not the path of best total score but the result of
merges in order of score; for it the same fold over the same edges merges the best neighbours step by step, on a bit
mask of boundaries, which gives the library's ids exactly.  Characters without a piece become byte pieces.

Words of more than LONGEST characters, and any in a model with longer pieces than that, are segmented in the task that
has the text, by the model's own rule: merges over a heap, or the path of best total score.  The piece table is sent to all tasks; its size is the vocabulary's.

Null text: null pieces and null decoded text.  Empty text: no pieces.  Texts that hold the meta sign itself decode to
a space there, as in the library.  Repeated rows are encoded each.  Null doc_ids are kept.  No documents: no rows.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm.blocks import block_count, pack, per_block, with_answers

META = "▁"
LONGEST = 60
#: A hot word stands in every block; its places are gathered over this many blocks at most.
BLOCKS_TOGETHER = 4096


@dataclass
class Pieces:
    """A piece table: ids by piece, scores, the ids of the 256 byte pieces, and the kind of model."""

    ids: dict[str, int]
    scores: list[float]
    bytes_ids: list[int]
    unknown: int
    merges: bool
    decoded: list[bytes]

    @staticmethod
    def load(path: str, merges: bool = True) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain, by_byte, decoded = {}, [model.unk_id()] * 256, []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                by_byte[int(piece[3:5], 16)] = i
                decoded.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                decoded.append(b"")
            else:
                plain[piece] = i
                decoded.append(piece.replace(META, " ").encode())
        return Pieces(plain, [model.get_score(i) for i in range(size)], by_byte, model.unk_id(), merges, decoded)

    @property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    def word_pattern(self) -> str:
        joined = set("".join(p for p in self.ids if len(p) > 1))
        if any(re.search(f"[^{META}]{META}", p) for p in self.ids):
            return r"(?s).+"  # pieces cross words: the whole text is one
        alone = re.escape("".join(chr(c) for c in range(128) if chr(c) not in joined))
        return rf"[{alone}]|{META}*[^{META}{alone}]+|{META}+"

    def whole(self, word: str) -> list[int]:
        """Ids of a word of any length by the model's own rule."""
        return self.merged(word) if self.merges else self.best_path(word)

    def best_path(self, word: str) -> list[int]:
        """Ids of the path of best total score, ties to the smaller ids from the start: the fold of unigram models."""
        strange = 10 - min(self.scores, default=0.0)
        cost, came = [0.0], [(0, 0)]

        def path(end: int) -> list[int]:
            ids = []
            while end:
                end, i = came[end]
                ids.append(i)
            return ids[::-1]

        for end in range(1, len(word) + 1):
            best = None
            for start in range(max(0, end - self.longest), end):
                i = self.ids.get(word[start:end])
                if i is None and start < end - 1:
                    continue
                total, i = (cost[start] + strange, -1 - ord(word[start])) if i is None else (cost[start] - self.scores[i], i)
                if best is None or total < best[0] or (total == best[0] and path(start) + [i] < path(best[1]) + [best[2]]):
                    best = (total, start, i)
            cost.append(best[0])
            came.append(best[1:])
        return [j for i in path(len(word)) for j in ([i] if i >= 0 else self.as_bytes(chr(-1 - i)))]

    def merged(self, word: str) -> list[int]:
        """Ids of a word by merges in order of score, leftmost first, over a linked list and a heap."""
        ends = list(range(1, len(word) + 1))
        before = list(range(-1, len(word) - 1))
        alive = [True] * len(word)
        heap: list = []

        def offer(i: int) -> None:
            j = ends[i]
            if j < len(word):
                piece = self.ids.get(word[i:ends[j]])
                if piece is not None:
                    heapq.heappush(heap, (-self.scores[piece], i, j, ends[j]))

        for i in range(len(word)):
            offer(i)
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if not (alive[i] and j < len(word) and alive[j] and ends[i] == j and ends[j] == end):
                continue
            ends[i] = end
            alive[j] = False
            if end < len(word):
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out: list[int] = []
        i = 0
        while i < len(word):
            piece = self.ids.get(word[i:ends[i]])
            out.extend(self.as_bytes(word[i:ends[i]]) if piece is None else [piece])
            i = ends[i]
        return out

    def as_bytes(self, text: str) -> list[int]:
        return [self.bytes_ids[b] for b in text.encode()]


def _written(text: str) -> str:
    return META + text.replace(" ", META) if text else ""


def _sent(words) -> list[str]:
    """The words of a block that go to the piece table, in an order that its documents' order does not change."""
    return sorted(w for w in words if len(w) <= LONGEST)


def _listed(pattern: str):
    words_in = re.compile(pattern)

    def run(block: int, docs: Iterator[pa.Table]) -> pa.Table:
        found: set[str] = set()
        for rows in docs:
            for text in rows.column("text").to_pylist():
                found.update(words_in.findall(_written(text or "")))
        words = _sent(found)
        return pa.table({"block": pa.array([block] * len(words), pa.int32()), "word": pa.array(words, pa.string()),
                         "place": pa.array(np.arange(len(words)), pa.int32())})
    return run


def lattice(words: DataFrame, pieces: Pieces, keys: list[str], carried: str) -> DataFrame:
    """keys, carried and edges: for each word all (start, end, id, score) where a piece, or a lone character, lies.

    words is partitioned by keys (word among them), so grouping the edges by word again moves nothing.
    """
    spark = words.sparkSession
    piece_rows = [(p, i, pieces.scores[i]) for p, i in pieces.ids.items()]
    table = F.broadcast(spark.createDataFrame(piece_rows, "piece string, id int, score double"))
    spans = F.expr(f"""flatten(transform(sequence(1, length(word)), s ->
        transform(sequence(1, least({pieces.longest}, length(word) - s + 1)), n -> struct(s - 1 AS s, s - 1 + n AS e))))""")
    exploded = words.select(*keys, carried, F.explode(spans).alias("span"))
    part = F.expr("substring(word, span.s + 1, span.e - span.s)")
    exploded = exploded.select(*keys, F.when(F.expr("span.s = 0 AND span.e = 1"), F.col(carried)).alias(carried),
                               "span", part.alias("part"))
    joined = exploded.join(table, F.col("part") == F.col("piece"), "left").where(
        "id IS NOT NULL OR span.e = span.s + 1")
    worst = min(pieces.scores, default=0.0) - 10
    edge = F.struct(
        F.coalesce(-F.col("score"), F.lit(-worst)).alias("cost"), F.col("span.s").alias("s"), F.col("span.e").alias("e"),
        F.coalesce("id", -1 - F.ascii("part")).alias("id"),
        F.expr("shiftleft(1L, span.s) | shiftleft(1L, span.e)").alias("ends"),
        F.expr("shiftleft(1L, span.e) - shiftleft(1L, span.s + 1)").alias("inside"))
    return joined.groupBy(*keys).agg(F.first(carried, ignorenulls=True).alias(carried), F.array_sort(F.collect_list(edge)).alias("edges"))


def folded(merges: bool) -> Column:
    """Ids of a word from its edges; a character without a piece is -1 less its code point."""
    if merges:
        # Bits of `b` are the boundaries.  A merge needs both ends of an edge and just one boundary between them; edges
        # stand in order of score, then start, so the first that can be merged is next.
        return F.expr("""transform(
            filter(array_sort(transform(edges, x -> struct(x.s AS s, x.e AS e, x.id AS id, x.ends AS ends, x.inside AS inside))),
                   x -> (bounds & x.ends) = x.ends AND (bounds & x.inside) = 0),
            x -> x.id)""")
    return F.expr("""aggregate(
        sequence(1, length(word)),
        array(struct(0D AS cost, cast(array() AS array<int>) AS ids)),
        (best, k) -> array_append(best, array_min(transform(filter(edges, x -> x.e = k),
            x -> struct(best[x.s].cost + x.cost AS cost, array_append(best[x.s].ids, x.id) AS ids)))),
        best -> best[length(word)].ids)""")


def segmented(words: DataFrame, pieces: Pieces, keys: list[str], carried: str) -> DataFrame:
    """keys, carried and ids of each word."""
    edges = lattice(words, pieces, keys, carried)
    if pieces.merges:
        edges = edges.withColumn("joins", F.expr("filter(edges, x -> x.e > x.s + 1)")).withColumn("bounds", F.expr("""
            aggregate(sequence(1, length(word)), shiftleft(1L, length(word) + 1) - 1L, (b, k) -> b & ~coalesce(
                get(filter(joins, x -> (b & x.ends) = x.ends AND bit_count(b & x.inside) = 1), 0).inside, 0L))"""))
    return edges.select(*keys, carried, folded(pieces.merges).alias("ids"))


def encode(docs: DataFrame, pieces: Pieces, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, text, pieces (ids) of every document."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    blocks = block_count(slim, block_bytes)
    packed = pack(slim, blocks, block_bytes)
    pattern = pieces.word_pattern()
    listed = per_block(packed, _listed(pattern), "block int, word string, place int")
    together = F.floor(F.col("block") / BLOCKS_TOGETHER).cast("int")
    # The words of a block become edges in eight tasks or more, so that a task groups its edges in memory.
    spread = listed.withColumn("range", together).repartition(8 * blocks, "word", "range")
    grouped = spread.groupBy("word", "range").agg(F.collect_list(F.struct("block", "place")).alias("places"))
    known = segmented(grouped, pieces, ["word", "range"], "places")
    answers = known.select(F.explode("places").alias("at"), "ids").select("at.block", "at.place", "ids")

    def finished(parts: Iterator[pa.Table], answers: pa.Table) -> pa.Table:
        # Ids stay in arrays: a block has too many words for a Python list each.
        words_in = re.compile(pattern)
        number: defaultdict = defaultdict(count().__next__)
        held = []
        for rows in parts:
            numbers = [np.fromiter(map(number.__getitem__, words_in.findall(_written(t or ""))), np.int32)
                       for t in rows.column("text").to_pylist()]
            held.append((rows, np.concatenate([np.zeros(0, np.int32), *numbers]),
                         np.r_[0, np.cumsum([len(n) for n in numbers], dtype=np.int64)]))
        words = _sent(number)
        slot = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        place = answers.column("place").to_numpy()
        known = pa.concat_arrays(answers.column("ids").chunks or [pa.array([], pa.list_(pa.int32()))])
        values, ends = known.flatten().to_numpy(), known.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        start, size = np.zeros(len(number), np.int64), np.full(len(number), -1, np.int64)
        start[slot[place]], size[slot[place]] = ends[:-1], np.diff(ends)
        # Words with characters that are no pieces, and words too long to be sent.
        strange = np.unique(np.searchsorted(ends, np.flatnonzero(values < 0), side="right") - 1)
        added = {int(slot[place[k]]): [j for i in values[ends[k]:ends[k + 1]].tolist()
                                       for j in ([i] if i >= 0 else pieces.as_bytes(chr(-1 - i)))] for k in strange.tolist()}
        if (size < 0).any():
            added |= {i: pieces.whole(word) for word, i in number.items() if size[i] < 0}
        extra, at = list(chain.from_iterable(added.values())), len(values)
        for i, ids in added.items():
            start[i], size[i], at = at, len(ids), at + len(ids)
        values = np.concatenate([values, np.array(extra, np.int32)])
        del number, words, slot, known
        out = []
        for rows, flat, of_text in held:
            lists = []
            # A few texts at a time, as places are eight bytes an id.
            for low in range(0, rows.num_rows, 64):
                text_at = of_text[low:low + 65]
                own = flat[text_at[0]:text_at[-1]]
                each = size[own]
                end = np.cumsum(each)
                ids = values[np.repeat(start[own] - (end - each), each) + np.arange(int(each.sum()))]
                lists.append(pa.ListArray.from_arrays(
                    pa.array(np.r_[0, end][text_at - text_at[0]], pa.int32()), pa.array(ids, pa.int32()),
                    mask=pa.concat_arrays(rows.column("text").slice(low, 64).is_null().chunks)))
            for low, ids in zip(range(0, rows.num_rows, 64), lists, strict=True):
                part = rows.slice(low, 64).combine_chunks()
                out.append(pa.table({"doc_id": part.column("doc_id"), "text": part.column("text"),
                                     "pieces": pa.chunked_array([ids])}))
        return pa.concat_tables(out)

    return with_answers(packed, answers, finished, "doc_id long, text string, pieces array<int>")


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """encoded with decoded: the text that its pieces stand for, without the space that encoding puts in front."""
    encoded = encoded.drop("decoded")
    columns, parts = encoded.columns, pieces.decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(parts, pa.large_binary())
        for batch in batches:
            ids = batch.column("pieces")
            joined = table.take(ids.flatten())  # the bytes of all its pieces, one after the other
            _, offsets, data = joined.buffers()
            ends = np.frombuffer(offsets, np.int64, len(joined) + 1, 8 * joined.offset) if len(joined) else np.zeros(1, np.int64)
            raw = memoryview(b"" if data is None else data)
            count_of = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            last = ends[np.cumsum(count_of)].tolist()
            texts = []
            for first, end, missing in zip([int(ends[0]), *last], last, ids.is_null().to_pylist(), strict=False):
                own = bytes(raw[first:end])
                texts.append(None if missing else (own[1:] if own[:1] == b" " else own).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*columns, "decoded"])

    return encoded.mapInArrow(run, StructType(list(encoded.schema.fields)).add("decoded", "string"))


def default_model() -> str:
    """The public byte-pair model that comes with the machine; a path of one's own goes to Pieces.load."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")

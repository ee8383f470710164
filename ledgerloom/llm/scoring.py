"""Log-probability of texts by online logistic context mixing, learned from the training fold of the corpus.

Method.  Text is a row of lower-cased words and an end mark.  A word is spelled bit by bit in a prefix code of its bytes and
an end-of-word sign; the end mark is the empty word.  Five hashed contexts (the last one, two, three and five bytes of
the word and all of it so far) each predict the next bit from counts gathered over all training words.  A weight set, chosen by how many of
the contexts have been seen and how often the longest one, mixes the five in the logistic domain; the weights are
learned online, leaving out the word's own count, and a last table refines the mixed chance by what came true.

The same mixing runs over words in the order of the texts.  A word's sign (its own for the most frequent ones, one for
each ending of the next, one for all others) is coded bit by bit under hashed contexts that cross words: none, the word
before the last one, the last one, the last two.  Training goes through the training texts once and is online: each few
words are predicted from the counts so far, the weights follow the error, and only then the words are counted.

A document's experts are the spelling alone, plain word counts whose mass for unknown words the spelling shares out
(escape chance times spelled chance), half of each, and the chance of a word's sign after the words before it times the
word's share of its sign by those counts, all blended with the document's own earlier words; they are weighed by how
well they have done so far, which adds up to the logarithm of their mean.

Two results come of them.  bits_per_byte is the code length of the words themselves, over all strings: an invented word
costs its spelling.  base_score and score hold all unknown words for one sign more, so that both are log-probabilities
over the same V + 1 signs and can be compared; there the experts give that sign what they leave to unknown words.

Scale.  Words are counted in blocks and summed over the corpus; the spelling is evaluated once for each distinct word, not
for each occurrence, and words reach the documents by block (see blocks.py).  The contexts of signs are counted and
evaluated at every word of every text; a task learns over its own texts, Spark sums counts and averages weights by words.
What is sent to all tasks are two tables of 2**table_bits context slots and the code of `heads` words, of fixed sizes by
parameter, and the mixing weights.  The word table grows with the corpus and is joined, never sent whole.

Null or empty text: the end mark alone.  A null doc_id is in the training fold.  Repeated rows count each time.  With
no training rows the contexts are empty and every bit costs about one.  No documents: no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.blocks import block_count, pack, per_block, with_answers
from ledgerloom.llm.common import durable
from ledgerloom.llm.language import held_out
from ledgerloom.llm.wordhash import mixed, pieces, text_bytes, word_hashes, word_spans

ORDERS = (1, 2, 3, 5)
CONTEXTS = len(ORDERS) + 1  # and the whole word so far
END = 32  # white space never stands inside a word, so its byte ends one
GATES, BUCKETS = (CONTEXTS + 1) * 6, 33
#: Experts of a document: the share given to its own earlier words once it is long.
CACHE_SHARES = (0.0, 0.2, 0.45)
LN10 = float(np.log(10))
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SALT = np.random.default_rng(5).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_code(weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Bits and length of each sign, shorter for heavier ones (lengths stay under 60)."""
    tick = count()
    heap = [(max(w, 0) + 1e-9 * max(sum(weights), 1), next(tick), [s]) for s, w in enumerate(weights)]
    heapq.heapify(heap)
    bits, length = np.zeros(len(weights), np.uint64), np.zeros(len(weights), np.int64)
    while len(heap) > 1:
        (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        for branch, signs in enumerate((left, right)):
            for s in signs:
                bits[s] |= np.uint64(branch << int(length[s]))
                length[s] += 1
        heapq.heappush(heap, (a + b, next(tick), left + right))
    return bits, length


class Coded:
    """Signs one after another: bits and length of each, and its hashed contexts."""

    bits: np.ndarray
    length: np.ndarray
    contexts: list[np.ndarray]

    def steps(self, table_bits: int):
        """For each bit place: the signs that have it, the bit, and the slots, a row for each context."""
        for k in range(int(self.length.max(initial=0))):
            on = np.flatnonzero(self.length > k)
            left = (self.length[on] - 1 - k).astype(np.uint64)
            bit = ((self.bits[on] >> left) & np.uint64(1)).astype(np.int8)
            node = (self.bits[on] >> (left + np.uint64(1))) | np.uint64(1 << k)
            node *= _SALT[15]
            slots = np.empty((len(self.contexts), len(on)), np.int64)
            for row, context in zip(slots, self.contexts, strict=True):
                # Contexts are mixed already, so one product spreads the node over the upper bits.
                row[:] = ((context[on] ^ node) * _SALT[14]) >> np.uint64(64 - table_bits)
            yield on, bit, slots


class Spelling(Coded):
    """The signs of a batch of words one after another, with the hashed contexts of each."""

    def __init__(self, words: list[bytes], code: tuple[np.ndarray, np.ndarray]):
        joined = b" ".join(words) + b" " if words else b""
        self.sign = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        self.word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(self.sign)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.bits, self.length = code[0][self.sign], code[1][self.sign]
        total = np.zeros(len(self.sign), np.uint64)
        self.contexts = []
        for back in range(1, max(ORDERS) + 1):
            before = np.zeros(len(self.sign), np.uint64)
            before[back:] = self.sign[:-back]
            before[place < back] = 0
            before[place == back - 1] = END
            total = total + (before + np.uint64(1)) * _SALT[back]
            if back in ORDERS:
                self.contexts.append(mixed(total + _SALT[8 + len(self.contexts)]))
        # The whole word so far: a sum over its bytes, each turned by its place, less what came before the word.
        turned = mixed((self.sign.astype(np.uint64) + np.uint64(1)) * _SALT[6] + place.astype(np.uint64) * _SALT[7])
        running = np.cumsum(turned, dtype=np.uint64) - turned
        start = np.repeat(running[np.cumsum(sizes) - sizes], sizes) if len(sizes) else running
        self.contexts.append(mixed(running - start + _SALT[8 + len(self.contexts)]))


class Lexicon:
    """A code of whole words by parameter: a sign for each of the `own` most frequent of `heads`, a sign for each hash of the
    last two bytes of the other heads, and one sign for all words besides.

    heads: words by falling count; counts: theirs.
    """

    def __init__(self, heads: list[bytes], counts: np.ndarray, n: int, own: int, endings: int = 32):
        hashes = hashes_of(heads)
        sign = np.array([i if i < own else own + zlib.crc32(w[-2:]) % endings for i, w in enumerate(heads)], np.int64)
        order = np.argsort(hashes)
        self.hashes, self.sign, self.rest = hashes[order], sign[order], own + endings
        self.words = np.bincount(sign, minlength=self.rest + 1)
        self.counts = np.bincount(sign, counts, self.rest + 1)
        self.counts[-1] = n - self.counts.sum()
        self.code = prefix_code(self.counts.tolist())

    def signs(self, hashes: np.ndarray) -> np.ndarray:
        """The sign of each word; the hash of a word is its name."""
        if not len(self.hashes):
            return np.full(len(hashes), self.rest)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.sign[at], self.rest)

    def masses(self, off: float, n: int) -> np.ndarray:
        """log10 of what plain counts less `off` a word give to all words of each sign, unknown ones among the rest."""
        if not n:
            return np.zeros(self.rest + 1)
        left = self.counts - off * self.words
        left[-1] = self.counts[-1] + off * self.words.sum()
        return np.log10(np.maximum(left, 1e-9) / n)


def hashes_of(words: list[bytes]) -> np.ndarray:
    sizes = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(sizes + 1) - 1
    return word_hashes(np.frombuffer(b" ".join([*words, b""]), np.uint8), end - sizes, end)


class InText(Coded):
    """Words of texts in their order, each under contexts that cross words: none, the word before the last one, the last one,
    and the last two of its text.

    A last word is known by itself where it is a head, else by its sign; the one before it by its sign.
    """

    CONTEXTS = 4

    def __init__(self, names: np.ndarray, signs: np.ndarray, place: np.ndarray, code, a: int, b: int):
        """Of the words a to b; names and signs of all, and the place of each in its text."""
        self.bits, self.length = code[0][signs[a:b]], code[1][signs[a:b]]

        def back(k: int, values: np.ndarray) -> np.ndarray:
            before = np.zeros(b - a, np.uint64)
            low = max(a, k)
            before[low - a:] = values[low - k:b - k] + np.uint64(1)
            before[place[a:b] < k] = 0
            return before * _SALT[k]

        second = back(2, signs)
        self.contexts = [mixed(total + _SALT[8 + i]) for i, total in enumerate(
            (np.zeros(b - a, np.uint64), second, back(1, names), back(1, signs) + second))]


def in_text(hashes: np.ndarray, at: np.ndarray, lexicon: Lexicon, most: int = 1 << 15):
    """For a few words at a time of the texts that begin at `at`: where they begin, and the words under their contexts."""
    signs = lexicon.signs(hashes)
    names = np.where(signs < lexicon.rest, hashes, np.uint64(lexicon.rest))
    place = np.arange(len(hashes)) - np.repeat(at[:-1], np.diff(at))
    signs = signs.astype(np.uint64)
    for a in range(0, len(hashes), most):
        yield a, InText(names, signs, place, lexicon.code, a, min(a + most, len(hashes)))


def _squash(x):
    return 1 / (1 + np.exp(-x))


class Mixer:
    """Weights by gate, and the table that refines the mixed chance."""

    def __init__(self, weights=None, hits=None, seen=None):
        self.weights = np.full((GATES, CONTEXTS), 0.3) if weights is None else weights
        middle = _squash((np.arange(BUCKETS) - BUCKETS // 2) / 2.0)
        self.seen = np.full((GATES, BUCKETS), 8.0) if seen is None else seen
        self.hits = self.seen * middle if hits is None else hits

    @staticmethod
    def inputs(zeros, ones):
        """Stretched predictions, a row for each context, and the gate of every bit; zeros and ones hold such rows."""
        x = np.log((ones + np.float32(0.3)) / (zeros + np.float32(0.3)))
        totals = zeros + ones
        known = (totals > 0).sum(0)
        top = np.take_along_axis(totals, np.maximum(known - 1, 0)[None], 0)[0]
        return x, known * 6 + sureness(top)

    def chance(self, x, gate):
        total = np.zeros(len(gate))
        for row, weights in zip(x, np.ascontiguousarray(self.weights.T), strict=True):
            total += row * weights[gate]
        return np.clip(total, -12, 12)

    def refine(self, logit, gate):
        at = np.clip(2 * logit + BUCKETS // 2, 0, BUCKETS - 1.001)
        low = at.astype(np.int64)
        part = at - low
        rate = self.hits / self.seen
        refined = (1 - part) * rate[gate, low] + part * rate[gate, low + 1]
        return np.clip(0.5 * _squash(logit) + 0.5 * refined, 1e-6, 1 - 1e-6)

    def learn(self, x, gate, bit, weight, rate: float = 0.02, step: int = 4096):
        """Online steps over slices of bits: the weights follow the error, the table counts what came true."""
        for a in range(0, len(bit), step):
            b = slice(a, a + step)
            logit = self.chance(x[:, b], gate[b])
            force = np.minimum(weight[b], 1e4) ** 0.5
            error = (bit[b] - _squash(logit)) * force
            change = np.stack([np.bincount(gate[b], error * row, GATES) for row in x[:, b]], 1)
            total = np.bincount(gate[b], force, GATES)
            self.weights += rate * change / np.maximum(total, 1)[:, None] * np.minimum(total, 50)[:, None] / 5
            np.clip(self.weights, -1, 3, out=self.weights)
            at = np.clip(np.rint(2 * logit + BUCKETS // 2), 0, BUCKETS - 1).astype(np.int64)
            place = gate[b] * BUCKETS + at
            self.seen += np.bincount(place, weight[b], GATES * BUCKETS).reshape(self.seen.shape)
            self.hits += np.bincount(place, weight[b] * bit[b], GATES * BUCKETS).reshape(self.hits.shape)


def _spelled(batch: pa.RecordBatch, code, most: int = 50_000):
    for a in range(0, batch.num_rows, most):
        part = batch.slice(a, most)
        yield part, Spelling(part.column("word").to_pylist(), code)


def _context_counts(words: DataFrame, code, table_bits: int) -> np.ndarray:
    """How often each slot saw a zero and a one, side by side, over all training words; 2**table_bits slots by parameter."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2 << table_bits)  # zeros in the first half, ones in the second
        for batch in batches:
            for part, spelling in _spelled(batch, code):
                times = part.column("c").to_numpy().astype(float)[spelling.word]
                for on, bit, slots in spelling.steps(table_bits):
                    for slot in slots:
                        np.add.at(seen, slot + (bit.astype(np.int64) << table_bits), times[on])
        seen = seen.reshape(2, -1)
        full = np.flatnonzero(seen.any(0))
        for part in np.array_split(full, len(full) // 100_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *[pa.array(seen[b][part]) for b in (0, 1)]],
                                             ["slot", "zeros", "ones"])

    slots = words.where("c > 0").mapInArrow(gather, "slot long, zeros double, ones double")
    slots = slots.groupBy("slot").agg(F.sum("zeros").cast("float").alias("zeros"), F.sum("ones").cast("float").alias("ones"))
    table = np.zeros((1 << table_bits, 2), np.float32)
    got = slots.select(F.col("slot").cast("int").alias("slot"), "zeros", "ones").toArrow()
    for k, name in enumerate(("zeros", "ones")):
        table[got.column("slot").to_numpy(), k] = got.column(name).to_numpy()
    return table


def _bits(spelling: Coded, table, table_bits: int, own=None):
    """Bit by bit: signs, bit, slots, inputs and gate; own: the count of the word to leave out of the table."""
    pairs = table.view(np.uint64)[:, 0]  # both counts of a slot in one read
    for on, bit, slots in spelling.steps(table_bits):
        seen = pairs[slots].view(np.float32).reshape(*slots.shape, 2)
        zeros, ones = seen[..., 0], seen[..., 1]
        if own is not None:
            zeros, ones = np.maximum(zeros - (bit == 0), 0), np.maximum(ones - (bit == 1), 0)
        yield on, bit, slots, *Mixer.inputs(zeros, ones)


def _fit_mixer(words: DataFrame, table, code, table_bits: int) -> Mixer:
    """The mixer learned online in every partition over all its words; the driver gets a few numbers from each."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, total = Mixer(), 0.0
        start = mixer.hits.copy(), mixer.seen.copy()
        for batch in batches:
            for part, spelling in _spelled(batch, code):
                times = part.column("c").to_numpy().astype(float)
                total += times.sum()
                for on, bit, _, x, gate in _bits(spelling, table.value, table_bits, own=True):
                    mixer.learn(x, gate, bit, times[spelling.word[on]])
        if total:
            yield pa.RecordBatch.from_arrays([
                pa.array([total]), *[pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for v in
                                     (mixer.weights * total, mixer.hits - start[0], mixer.seen - start[1])]],
                ["total", "weights", "hits", "seen"])

    parts = words.where("c > 0").mapInArrow(
        learn, "total double, weights array<double>, hits array<double>, seen array<double>")
    # Sums by place over the partitions, by Spark; what comes back has one row for each weight.
    sums = {}
    total = 0.0
    parts = durable(parts)
    for name in ("weights", "hits", "seen"):
        places = parts.select(F.posexplode(name)).groupBy("pos").agg(F.sum("col").alias("v")).toPandas()
        if not len(places):
            return Mixer()
        sums[name] = places.sort_values("pos")["v"].to_numpy()
    total = parts.agg(F.sum("total")).first()[0]
    fresh = Mixer()
    return Mixer(sums["weights"].reshape(fresh.weights.shape) / total,
                 fresh.hits + sums["hits"].reshape(fresh.hits.shape), fresh.seen + sums["seen"].reshape(fresh.seen.shape))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of every text's words and its end mark, and where each text begins (one more at the end)."""
    raw, offsets = text_bytes(column)
    begin, end, first = word_spans(raw, offsets)
    at = first + np.arange(len(first))
    hashes = np.full(at[-1], hashes_of([b""])[0])
    marks = np.zeros(at[-1], bool)
    marks[at[1:] - 1] = True
    hashes[~marks] = word_hashes(raw, begin, end)
    return hashes, at


def leaning(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The stretched chance of a one where so many zeros and ones were seen."""
    return np.log((ones + np.float32(0.3)) / (zeros + np.float32(0.3)))


def sureness(seen: np.ndarray) -> np.ndarray:
    """0 to 5 by how often a slot was seen: half the whole logarithm, to the base 2, of one more."""
    return np.minimum((np.frexp(seen + np.float32(1))[1] - 1) >> 1, 5)


def crossing_gate(last_two: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The gate of a bit in a text: how sure the last two words and the last word are."""
    return (last_two * 6 + last).astype(np.int64)


def leanings(counts: np.ndarray) -> np.ndarray:
    """For each slot its leaning and how sure it is, side by side."""
    return np.stack([leaning(counts[:, 0], counts[:, 1]), sureness(counts.sum(1)).astype(np.float32)], 1)


def learned_online(texts: Iterator[pa.Array], lexicon: Lexicon, table_bits: int):
    """Counts and mixer of a run of texts, word by word in their order: each few words are first predicted from what came
    before, which moves the mixer's weights, and then counted.  Also how many words there were."""
    counts, mixer, total = np.zeros((1 << table_bits, 2), np.uint32), Mixer(np.full((GATES, InText.CONTEXTS), 0.3)), 0
    pairs, cells = counts.view(np.uint64)[:, 0], counts.reshape(-1)
    one = np.uint32(1)
    for column in texts:
        hashes, at = tokens_of(column)
        total += len(hashes)
        for _, words in in_text(hashes, at, lexicon):
            for _, bit, slots in words.steps(table_bits):
                seen = pairs[slots].view(np.uint32).reshape(*slots.shape, 2).astype(np.float32)
                zeros, ones = seen[..., 0], seen[..., 1]
                gate = crossing_gate(*sureness(zeros[[3, 2]] + ones[[3, 2]]))
                mixer.learn(leaning(zeros, ones), gate, bit, np.ones(len(bit)))
                for slot in slots:
                    np.add.at(cells, 2 * slot + bit, one)
    return counts, mixer, total


#: The slots of a task's counts travel and are summed in so many rows.
SLOT_RANGES = 64


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes before all second ones, compressed."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return pa.Codec("zstd").compress(raw, asbytes=True)


def _unsqueezed(packed: bytes, size: int, kind) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(packed, size * np.dtype(kind).itemsize, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, size).T).reshape(-1).view(kind)


def crossings(training: DataFrame, lexicon: Lexicon, table_bits: int) -> tuple[np.ndarray, Mixer]:
    """Counts of the slots and mixer learned online in every task over its texts; Spark sums counts, and weights by words.

    The driver gets 2**table_bits slots and the mixer's few numbers.
    """
    fresh = Mixer(np.full((GATES, InText.CONTEXTS), 0.3))
    schema = "part int, size int, packed binary"
    names = ["part", "size", "packed"]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (part.column("text") for batch in batches for part in pieces(batch, "text"))
        counts, mixer, total = learned_online(texts, lexicon, table_bits)
        if not total:
            return
        numbers = np.concatenate([[total], (mixer.weights * total).ravel(), (mixer.hits - fresh.hits).ravel(),
                                  (mixer.seen - fresh.seen).ravel()])
        for k, some in enumerate(np.array_split(counts.reshape(-1), SLOT_RANGES)):
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "size": pa.array([len(some)], pa.int32()),
                                              "packed": [_squeezed(some)]})
        yield pa.RecordBatch.from_pydict({"part": pa.array([-1], pa.int32()), "size": pa.array([len(numbers)], pa.int32()),
                                          "packed": [_squeezed(numbers)]})

    def added(rows: pa.Table) -> pa.Table:
        part, size = rows.column("part")[0].as_py(), rows.column("size")[0].as_py()
        total = np.zeros(size)
        for packed in rows.column("packed"):
            total += _unsqueezed(packed.as_py(), size, np.uint32 if part >= 0 else np.float64)
        return pa.table({"part": pa.array([part], pa.int32()), "size": pa.array([size], pa.int32()), "packed": [_squeezed(total)]})

    got = training.select("text").mapInArrow(learn, schema).groupBy("part").applyInArrow(added, schema).toArrow()
    sums = {p: _unsqueezed(packed, size, np.float64) for p, size, packed in zip(*(got.column(c).to_pylist() for c in names), strict=True)}
    if not sums:
        return np.zeros((1 << table_bits, 2), np.float32), fresh
    numbers = sums.pop(-1)
    weights, hits, _ = np.split(numbers[1:], [fresh.weights.size, fresh.weights.size + fresh.hits.size])
    counts = np.concatenate([sums[k].astype(np.float32) for k in sorted(sums)]).reshape(-1, 2)
    return counts, Mixer(weights.reshape(fresh.weights.shape) / numbers[0], fresh.hits + hits.reshape(fresh.hits.shape),
                                   fresh.seen + numbers[-fresh.seen.size:].reshape(fresh.seen.shape))


@lru_cache(maxsize=1)
def _sent_leanings(packed: bytes, slots: int) -> np.ndarray:
    """Leanings of the slots whose squeezed counts were sent; a worker works them out once."""
    return leanings(_unsqueezed(packed, 2 * slots, np.float32).reshape(-1, 2))


def sign_chances(hashes: np.ndarray, at: np.ndarray, lexicon: Lexicon, slots_lean: np.ndarray, mixer: Mixer) -> np.ndarray:
    """log10 of the chance of each word's sign after the words before it in its text."""
    pairs, table_bits = slots_lean.view(np.uint64)[:, 0], int(len(slots_lean)).bit_length() - 1
    found = np.zeros(len(hashes))
    for a, words in in_text(hashes, at, lexicon):
        for on, bit, slots in words.steps(table_bits):
            seen = pairs[slots].view(np.float32).reshape(*slots.shape, 2)
            gate = crossing_gate(seen[3, :, 1], seen[2, :, 1])
            one = mixer.refine(mixer.chance(seen[..., 0], gate), gate)
            found[a + on] += np.log(np.where(bit == 1, one, 1 - one))
    return found / LN10


def _word_costs(words: DataFrame, table, mixer: Mixer, code, table_bits: int) -> DataFrame:
    """word, c, cost: minus the log10 of the word's probability under the mixed contexts."""

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, spelling in _spelled(batch, code):
                total = np.zeros(part.num_rows)
                for on, bit, _, x, gate in _bits(spelling, table.value, table_bits):
                    one = mixer.refine(mixer.chance(x, gate), gate)
                    total += np.bincount(spelling.word[on], -np.log10(np.where(bit == 1, one, 1 - one)), part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(total)], ["word", "c", "cost"])

    return words.mapInArrow(cost, "word binary, c long, cost double")


#: Blocks whose places of a word stand in one row, so that no row grows with the corpus.
BLOCKS_TOGETHER = 1024


def _listed(block: int, docs: Iterator[pa.Table]) -> pa.Table:
    """The distinct words of a block and how often its training documents have them."""
    trained, all_words = Counter(), set()
    for rows in docs:
        for text, out in zip(rows.column("text").to_pylist(), rows.column("held_out").to_pylist(), strict=True):
            words = (text or "").encode().translate(_LOWER).split()
            words.append(b"")
            (all_words if out else trained).update(words)
    all_words.update(trained)
    words = sorted(all_words)
    return pa.table({"block": pa.array([block] * len(words), pa.int32()), "word": pa.array(words, pa.binary()),
                     "n": pa.array([trained[w] for w in words], pa.int64())})


def _document_scores(flat, at, experts, crossed):
    """log10 probability of each document: the mean over experts, each of which also expects earlier words again.

    experts: log10 probabilities by word, a row each; crossed: those of an expert that knows the words before, by place.
    """
    docs = np.repeat(np.arange(len(at) - 1), np.diff(at))
    # One number for a document and word, and one sort of them: documents stand in order already.
    both = docs * (int(flat.max(initial=0)) + 1) + flat
    order = np.argsort(both, kind="stable")
    both = both[order]
    first = np.r_[True, both[1:] != both[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(flat)), 0))
    earlier = np.empty(len(flat), np.int64)
    earlier[order] = np.arange(len(flat)) - start  # how often the document had this word before
    place = np.arange(len(flat)) - at[docs]
    back = np.flatnonzero(earlier)
    returned = np.log10(earlier[back] / place[back])
    found = {}
    chances = [*[by_word[flat] for by_word in experts], crossed]
    for k, share in enumerate(CACHE_SHARES):
        own = share * place / (place + 30.0)
        fresh, again = (np.log10(1 - own), returned + np.log10(own[back])) if share else (0.0, None)
        for e, plain in enumerate(chances):
            p = plain + fresh
            if share:
                p[back] = np.logaddexp(p[back] * LN10, again * LN10) / LN10
            found[k, e] = np.add.reduceat(p, at[:-1])
    found = np.stack([found[key] for key in sorted(found)])
    best = found.max(0)
    return best + np.log10((10.0 ** (found - best)).mean(0))


def spelled_words(words: DataFrame, table_bits: int) -> DataFrame:
    """word, c, cost of the mixed contexts alone, learned from the words of c > 0."""
    code = prefix_code(_sign_weights(words))
    table = words.sparkSession.sparkContext.broadcast(_context_counts(words, code, table_bits))
    costs = durable(_word_costs(words, table, _fit_mixer(words, table, code, table_bits), code, table_bits))
    table.destroy()
    return costs


def taken_off(v: int, once: int) -> float:
    """What plain counts take off each known word for the unknown ones."""
    return min(max(once / v, 0.05), 0.95) if v else 0.0


def word_experts(c, spelled, n: int, v: int, once: int, heard: float):
    """log10 of each word's chance over all strings, and over known words and one sign for all others; a row per expert.

    Plain counts take so much off each known word that unknown ones get the share of words seen once.  `heard` is what
    the spelling gives to all known words together.
    """
    off = taken_off(v, once)
    unheard = np.log10(max(1 - heard, 1e-6))
    escape = np.log10(off * v / n) if n else 0.0
    known = np.log10(np.maximum(c - off, 1e-9) / max(n, 1))
    found = []
    for apart in (spelled, np.full(len(c), unheard)):
        spelling = np.where(c > 0, spelled, apart)
        counted = np.where(c > 0, known, escape + apart - unheard)
        found.append([spelling, counted, np.logaddexp(counted * LN10, spelling * LN10) / LN10 - np.log10(2)])
    return found


#: Documents of a block are scored together up to about so many words, which bounds what stands in memory beside a text.
WORDS_TOGETHER = 1 << 18


def score_documents(docs: DataFrame, table_bits: int = 22, block_bytes: int = 24 << 20, heads: int = 1 << 16, own: int = 255) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"),
                       held_out(F.col("doc_id"), 5, 1).alias("held_out"))
    blocks = block_count(slim, block_bytes)
    packed = pack(slim, blocks, block_bytes)
    listed = per_block(packed, _listed, "block int, word binary, n long")
    # A row for each word and range of blocks: a word's blocks stay together and are sent once.
    places = durable(listed.groupBy("word", F.floor(F.col("block") / BLOCKS_TOGETHER).cast("int").alias("range")).agg(
        F.sum("n").alias("n"), F.collect_list("block").alias("blocks")))
    words = durable(places.groupBy("word").agg(F.sum("n").alias("c")))
    n, v, once = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
    top = words.where("c > 0").orderBy(F.desc("c"), "word").limit(heads).toArrow()
    lexicon = Lexicon(top.column("word").to_pylist(), top.column("c").to_numpy(), n, own)
    # A task sends a table of slots, so there are no more tasks than blocks, however many files there are.
    counts, mixer = crossings(slim.where("NOT held_out").coalesce(blocks), lexicon, table_bits)
    sent, masses = docs.sparkSession.sparkContext.broadcast(_squeezed(counts.reshape(-1))), lexicon.masses(taken_off(v, once), n)
    costs = spelled_words(words, table_bits)
    heard = costs.where("c > 0").agg(F.coalesce(F.sum(F.expr("power(10D, -cost)")), F.lit(0.0))).first()[0]
    answers = places.select("word", "blocks").join(costs, "word").select(F.explode("blocks").alias("block"), "word", "c", "cost")

    def finished(parts: Iterator[pa.Table], known: pa.Table) -> pa.Table:
        names = known.column("word").to_pylist()
        number = {w: i for i, w in enumerate(names)}
        c = known.column("c").to_numpy()
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        spelled = -known.column("cost").to_numpy()
        whole, classed = word_experts(c, spelled, n, v, once, heard)
        hashes, lean = hashes_of(names), _sent_leanings(sent.value, 1 << table_bits)
        own_mass = masses[lexicon.signs(hashes)]
        # Unknown words are one sign of the class; any of them stands for it.
        sign = np.where(c > 0, np.arange(len(c)), np.argmin(c) if len(c) else 0)
        out = []
        for rows in parts:
            ids, sizes, lengths = [], [], []
            for text in rows.column("text").to_pylist():
                raw = (text or "").encode()
                tokens = raw.translate(_LOWER).split()
                tokens.append(b"")
                ids.append(np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens)))
                sizes.append(len(tokens))
                lengths.append(len(raw))
            at = np.r_[0, np.cumsum(sizes)]
            first = np.flatnonzero(np.diff(at[:-1] // WORDS_TOGETHER, prepend=-1))
            sums = []
            for low, high in zip(first, [*first[1:], len(sizes)], strict=True):
                flat, inner = np.concatenate(ids[low:high]), at[low:high + 1] - at[low]
                # An expert that knows the words before: the chance of a word's sign there, and its share of that sign.
                signed = sign_chances(hashes[flat], inner, lexicon, lean, mixer) - own_mass[flat]
                sums.append([np.add.reduceat((c[flat] > 0).astype(np.int64), inner[:-1]), np.add.reduceat(base[flat], inner[:-1]),
                             *[_document_scores(of, inner, by_word, signed + by_word[1][of])
                               for of, by_word in ((sign[flat], classed), (flat, whole))]])
            n_known, based, score, coded = map(np.concatenate, zip(*sums, strict=True))
            out.append(pa.table({
                "doc_id": rows.column("doc_id").combine_chunks(), "held_out": rows.column("held_out").combine_chunks(),
                "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(n_known),
                "train_tokens": pa.array(np.full(len(sizes), n), pa.int64()),
                "base_score": pa.array(based), "score": pa.array(score),
                "bits_per_byte": pa.array(-coded / np.log10(2) / np.maximum(lengths, 1))}))
        return pa.concat_tables(out)

    return with_answers(packed, answers, finished,
                        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
                        " base_score double, score double, bits_per_byte double")


def _sign_weights(words: DataFrame) -> list[float]:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("word").to_pylist()
            sizes = np.array([len(w) for w in column])
            times = batch.column("c").to_numpy().astype(float)
            total += np.bincount(np.frombuffer(b"".join(column), np.uint8), np.repeat(times, sizes), 256)
            total[END] += times.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total)], ["sign", "n"])

    got = words.where("c > 0").mapInArrow(weigh, "sign int, n double").groupBy("sign").agg(F.sum("n").alias("n")).collect()
    weights = [0.0] * 256
    for row in got:
        weights[row["sign"]] = row["n"]
    return weights

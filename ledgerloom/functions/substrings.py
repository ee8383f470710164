"""Which texts contain which needles, through an index of short fixed-length pieces instead of a cross join.

Every needle is found by one piece of it: the one that occurs least often in the texts.  Texts are cut into their pieces
of that length, once whatever the needles' lengths; a piece that is some needle's leads to a candidate, and `contains`
confirms it.  Needles shorter than the longest piece length use a shorter one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of pieces.  A needle uses the longest that fits in it.
LENGTHS = (8, 4, 2, 1)
#: Characters looked at in one step: finding a place in a text costs time in proportion to the place.
STRETCH = 256
#: Marks that stand for all needles' pieces in `narrowed`, whatever their number: 128 kB.
MARKS = 1 << 20


def piece_length(size: Column) -> Column:
    chosen = F.lit(None).cast("int")
    for length in sorted(LENGTHS):
        chosen = F.when(size >= length, F.lit(length)).otherwise(chosen)
    return chosen


def _pieces(text: Column, length: Column) -> Column:
    """The distinct pieces of a text of at most a few hundred characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - length + 1), lambda at: F.substring(text, at, length)))


def _stretches(text: Column) -> Column:
    """The text in overlapping stretches, so that each piece lies whole in one of them."""
    overlapping = rf"(?s)(?=(.{{1,{STRETCH + max(LENGTHS) - 1}}})).{{1,{STRETCH}}}"
    return F.when(F.octet_length(text) <= STRETCH, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(overlapping), F.lit(1)))


def _exploded(rows: DataFrame, text: str, lengths: Column, keep: list[str]) -> DataFrame:
    """keep, _length, _piece: the pieces of every wanted length, one row each within a stretch."""
    return (
        rows.select(*keep, F.explode(_stretches(F.col(text))).alias("_stretch"), lengths.alias("_wanted"))
        .select(*keep, "_stretch", F.explode("_wanted").alias("_length"))
        .where(F.length("_stretch") >= F.col("_length"))
        .select(*keep, "_length", F.explode(_pieces(F.col("_stretch"), F.col("_length"))).alias("_piece"))
    )


def anchors(texts: DataFrame, text: str, needles: DataFrame) -> DataFrame:
    """(_needle, _length, _piece): for each needle the piece that the fewest stretches of the texts hold, ties by text."""
    own = _exploded(needles.withColumn("_size", piece_length(F.length("_needle"))), "_needle", F.array("_size"), ["_needle"]).distinct()
    lengths = needles.select(F.collect_set(piece_length(F.length("_needle"))).alias("_lengths"))  # a row of up to four numbers
    wanted = own.select("_length", "_piece").distinct()
    found = (
        _exploded(texts.select(text).crossJoin(F.broadcast(lengths)), text, F.col("_lengths"), [])
        .join(wanted, ["_length", "_piece"], "left_semi").groupBy("_length", "_piece").agg(F.count("*").alias("_n"))
    )
    # A piece that no text holds proves that the needle is in none.
    placed = own.join(found, ["_length", "_piece"], "left").groupBy("_needle").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0).cast("long")).alias("n"), F.col("_length").alias("length"), F.col("_piece").alias("piece"))).alias("rarest"))
    return placed.where("rarest.n > 0").select("_needle", F.col("rarest.length").alias("_length"), F.col("rarest.piece").alias("_piece"))


def _place(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(MARKS))


def _marks(pieces: DataFrame, piece: str) -> Column:
    """One array of 64-bit words that has the bit of every piece's hash set."""
    set_bits = pieces.select(_place(F.col(piece)).alias("_at")).select(
        F.floor(F.col("_at") / 64).alias("_word"), F.expr("shiftleft(1L, CAST(_at % 64 AS INT))").alias("_bits"))
    blank = pieces.sparkSession.range(MARKS // 64).select(F.col("id").alias("_word"), F.lit(0).cast("long").alias("_bits"))
    words = set_bits.unionByName(blank).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    return words.agg(F.array_sort(F.collect_list(F.struct("_word", "_bits"))).getField("_bits")).scalar()


def narrowed(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """The text rows without most of those in which no needle is found; none that holds a needle is lost.

    A row stays where any piece of its text has the hash of some needle's piece.  The marks have one size whatever the
    needles, so nothing is shuffled but the rows that stay; too many needles for them let more rows stay.
    """
    known = needles.where(F.length(needle) > 0).select(F.col(needle).alias("_needle")).distinct()
    own = _exploded(known.withColumn("_size", piece_length(F.length("_needle"))), "_needle", F.array("_size"), [])
    lengths = known.select(F.collect_set(piece_length(F.length("_needle"))).alias("_lengths"))
    kept = [*texts.columns, "_row"]
    places = (
        texts.withColumn("_row", F.monotonically_increasing_id()).crossJoin(F.broadcast(lengths))
        .select(*kept, "_lengths", F.explode(_stretches(F.col(text))).alias("_stretch"))
        .select(*kept, "_stretch", F.explode("_lengths").alias("_length")).where(F.length("_stretch") >= F.col("_length"))
        .select(*kept, "_stretch", "_length", F.explode(F.sequence(F.lit(1), F.length("_stretch") - F.col("_length") + 1)).alias("_from"))
        .select(*kept, _place(F.substring("_stretch", F.col("_from"), F.col("_length"))).alias("_at"))
    )
    word = F.element_at(_marks(own, "_piece"), F.floor(F.col("_at") / 64).cast("int") + 1)
    return places.where(F.getbit(word, (F.col("_at") % 64).cast("int")) == 1).select(*kept).distinct().drop("_row")


def containing(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Pairs of text rows and the needles found anywhere inside them.

    Only keys of texts travel with the pieces; each text travels once, to its candidates.  The key is a hash: two texts of
    one hash share their candidates, and each is confirmed by its own text.  Null or empty texts and needles match nothing.
    """
    known = needles.where(F.length(needle) > 0).select(F.col(needle).alias("_needle")).distinct()
    found_by = anchors(texts, text, known)
    lengths = found_by.select(F.collect_set("_length").alias("_lengths"))
    keyed = texts.where(F.length(text) > 0).withColumn("_key", F.xxhash64(text))
    distinct = keyed.select("_key", text).distinct()
    cut = _exploded(distinct.crossJoin(F.broadcast(lengths)), text, F.col("_lengths"), ["_key"])
    candidates = cut.join(found_by, ["_length", "_piece"]).select("_key", "_needle").distinct()
    return (
        keyed.join(candidates, "_key").where(F.contains(F.col(text), F.col("_needle")))
        .drop("_key").withColumnRenamed("_needle", needle)
    )

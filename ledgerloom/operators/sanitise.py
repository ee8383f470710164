"""Masking identifiers, and proving on the output that none survive.

Replacement is one native pass per value: the text is split at every identifier
shape and the pieces are put back around stable pseudonyms.  No lookup table
exists; the same input always gives the same pseudonym, so joins still work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schema
from ledgerloom.functions.columns import count_where, rows
from ledgerloom.functions.profile import counts_by_column, string_columns
from ledgerloom.functions.substrings import containing, narrowed
from ledgerloom.session import ensure_checkpoint_dir

DEFAULT_SALT = "ledgerloom"

# --- fixed values: identifier shapes, and those that free text is searched for ---
GUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
BILLING_CODE = r"\b[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{3}-[A-Z0-9]{3}\b"
CODE_TEMPLATE = "XXXX-XXXX-XXX-XXX"
SHAPES = {
    "GUID": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "Azure subscription": r"/subscriptions/[^\s\"'`)\]]+",
    "Azure billing scope": r"/providers/Microsoft\.Billing/[^\s\"'`)\]]+",
    "email address": r"[\w.+-]+@[\w-]+\.[\w.]{2,}",
    "tenant domain": r"\b[\w-]+\.onmicrosoft\.com\b",
}
# --- fixed values: identifier-shaped text that is published on purpose ---------
PUBLISHED = (r"^(0{8}-0{4}-0{4}-0{4}-0{12}|\{[A-Z_]+\}|534c40a5-5207-406a-a372-6f8308b56aaa)$")

# Text without its marker cannot contain the shape.
MARKERS = {"GUID": "-", "Azure subscription": "/subscriptions/", "Azure billing scope": "/providers/",
           "email address": "@", "tenant domain": ".onmicrosoft.com"}
# Letters, digits and spaces of any script, as the patterns are meant.
ANY_SCRIPT = "(?U)"
IDENTIFIER = f"{GUID}|{BILLING_CODE}"
GUID_SIZE, CODE_SIZE = 36, len(CODE_TEMPLATE)
# The columns of a frame's values, each once for its column, with the rows that hold it.
VALUES = ["_column", "_value", "_rows"]


def _shaped(digest: Column, sizes: list[int]) -> Column:
    """Cut a digest into dashed groups.

    Each dash goes in by itself, so the digest is an argument once: a repeated expression would be computed again each time
    it is named.
    """
    shaped, at = F.substring(digest, 1, sum(sizes)), 0
    for size in sizes[:-1]:
        at += size + 1
        shaped = F.overlay(shaped, F.lit("-"), F.lit(at), F.lit(0))
    return shaped


def pseudonym_guid(token: Column, salt: str) -> Column:
    return _shaped(F.sha2(F.concat(F.lit(salt), token), 256), [8, 4, 4, 4, 12])


def pseudonym_code(token: Column, salt: str) -> Column:
    return _shaped(F.upper(F.sha2(F.concat(F.lit(salt), token), 256)), [len(p) for p in CODE_TEMPLATE.split("-")])


def _may_hold(text: Column, size: int) -> Column:
    """Whether a value is long enough for an identifier and has a dash; most values are spared the expression."""
    return (F.octet_length(text) >= size) & F.contains(text, F.lit("-"))


def _replace_all(text: Column, pattern: str, pseudonym, size: int) -> Column:
    """Every match of a shape, replaced in one left-to-right pass."""
    around = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rebuilt = F.zip_with(around, found, lambda piece, token: F.concat(
        piece, F.coalesce(pseudonym(token), F.lit(""))))
    # Untouched values skip the split entirely.
    return F.when(_may_hold(text, size) & text.rlike(pattern), F.array_join(rebuilt, "")).otherwise(text)


def pseudonymise_guids(text: Column, salt: str = DEFAULT_SALT) -> Column:
    return _replace_all(text, GUID, lambda t: pseudonym_guid(t, salt), GUID_SIZE)


def pseudonymise_codes(text: Column, salt: str = DEFAULT_SALT) -> Column:
    return _replace_all(text, BILLING_CODE, lambda t: pseudonym_code(t, salt), CODE_SIZE)


def _replaced(frame: DataFrame, names: list[str], pattern: str, pseudonym, size: int, every) -> DataFrame:
    """These text columns with every match of a shape replaced; all matches of the shape have this many characters.

    Most values hold one identifier.  It is found, cut out and replaced by compiled functions, a step for each, so that
    none is computed twice.  A value that holds more, or letters beyond ASCII (where places are counted otherwise), goes
    through `every`, which does the same to any value by a lambda and an expression compiled anew for each value.
    """
    def place(text: Column) -> Column:
        ascii_only = F.octet_length(text) == F.length(text)
        return F.when(_may_hold(text, size), F.when(ascii_only, F.regexp_instr(text, F.lit(pattern))).otherwise(-1))

    def made_of(text: Column, at: Column) -> Column:
        # A shape that begins in the rest of a value begins there in the whole value or makes it take the longer way.
        rest = F.substring(text, at + size, F.octet_length(text))
        return F.when((at > 0) & ~(_may_hold(rest, size) & rest.rlike(pattern)), pseudonym(F.substring(text, at, F.lit(size))))

    def result(n: int, text: Column) -> Column:
        at, made = F.col(f"_at_{n}"), F.col(f"_made_{n}")
        return F.when(made.isNotNull(), F.overlay(text, made, at, F.lit(size))).when(at != 0, every(text)).otherwise(text)

    placed = frame.select("*", *[place(F.col(c)).alias(f"_at_{n}") for n, c in enumerate(names)])
    digested = placed.select("*", *[made_of(F.col(c), F.col(f"_at_{n}")).alias(f"_made_{n}") for n, c in enumerate(names)])
    done = {c: result(n, F.col(c)).alias(c) for n, c in enumerate(names)}
    return digested.select(*[done.get(c, F.col(c)) for c in frame.columns])


def with_guids_replaced(frame: DataFrame, names: list[str], salt: str = DEFAULT_SALT) -> DataFrame:
    """`pseudonymise_guids` on columns of a frame."""
    return _replaced(frame, names, GUID, lambda t: pseudonym_guid(t, salt), GUID_SIZE, lambda t: pseudonymise_guids(t, salt))


def with_codes_replaced(frame: DataFrame, names: list[str], salt: str = DEFAULT_SALT) -> DataFrame:
    """`pseudonymise_codes` on columns of a frame."""
    return _replaced(frame, names, BILLING_CODE, lambda t: pseudonym_code(t, salt), CODE_SIZE, lambda t: pseudonymise_codes(t, salt))


def sanitise_text(text: Column, salt: str = DEFAULT_SALT) -> Column:
    """Both shapes in one pass: their groups have other sizes, so no match of one overlaps a match of the other."""
    return _replace_all(text, IDENTIFIER, lambda t: F.when(F.length(t) == GUID_SIZE, pseudonym_guid(t, salt)).otherwise(
        pseudonym_code(t, salt)), CODE_SIZE)


def mask_names(frame: DataFrame) -> DataFrame:
    """Columns that hold a name by definition are overwritten, nulls kept."""
    return frame.withColumns({
        c: F.when(F.col(c).isNotNull(), F.lit(mask))
        for c, mask in schema.NAME_MASKS.items() if c in frame.columns})


def sanitise(frame: DataFrame, salt: str = DEFAULT_SALT, spare: tuple[str, ...] = ()) -> DataFrame:
    """Mask names and sweep every other string column; ``spare`` is for tests of the proof.

    Of a frame's `column_values` each value is masked or swept as its column is.
    """
    if frame.columns == VALUES:
        column, value = F.col("_column"), F.col("_value")
        made = F.when(column.isin(*spare), value)
        for name, mask in schema.NAME_MASKS.items():
            made = made.when(column == name, F.lit(mask))
        return frame.withColumn("_value", made.otherwise(sanitise_text(value, salt)))
    swept = [c for c in string_columns(frame) if c not in schema.NAME_MASKS and c not in spare]
    masks = {c: F.when(F.col(c).isNotNull(), F.lit(m)) for c, m in schema.NAME_MASKS.items()
             if c in frame.columns and c not in spare}
    return frame.withColumns({**masks, **{c: sanitise_text(F.col(c), salt) for c in swept}})


def sanitise_report(frame: DataFrame) -> DataFrame:
    """Values each column's sweep changes, or masks, counted in one scan."""
    counted = {}
    for name in string_columns(frame):
        if name in schema.NAME_MASKS:
            counted[name] = F.count(F.col(name))
        else:
            counted[name] = count_where(holds_identifier(F.col(name)))
    return (
        counts_by_column(frame, counted, "column_name", "values_changed").where("values_changed > 0")
        .withColumn("kind", F.when(F.col("column_name").isin(*schema.NAME_MASKS), "name").otherwise("identifier"))
    )


def sanitise_nested(column: Column, kind: T.DataType, salt: str = DEFAULT_SALT) -> Column:
    """Sweep every string inside a struct, array or map column."""
    if isinstance(kind, T.StringType):
        return sanitise_text(column, salt)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda e: sanitise_nested(e, kind.elementType, salt))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: sanitise_nested(v, kind.valueType, salt))
    if isinstance(kind, T.StructType):
        fields = [sanitise_nested(column[f.name], f.dataType, salt).alias(f.name) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def column_values(frame: DataFrame) -> DataFrame:
    """(_column, _value, _rows): the distinct text of every string column and how many rows hold it, nulls left out.

    Found in one pass and kept in the checkpoint folder, so that what reads them does not run the frame again.  `sanitise`
    and `leak_scan` take them in the frame's place.
    """
    names = string_columns(frame)
    # Short keys: a name goes through the aggregate with every value.
    short = frame.select(*[F.col(c).alias(str(n)) for n, c in enumerate(names)])
    found = (
        short.unpivot([], short.columns, "_n", "_value").where("_value IS NOT NULL")
        .groupBy("_n", "_value").agg(rows().alias("_rows"))
        .select(F.get(F.array(*[F.lit(c) for c in names]), F.col("_n").cast("int")).alias("_column"), "_value", "_rows")
    )
    spark = frame.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/column-values-{uuid.uuid4().hex}"
    found.write.parquet(folder)
    return spark.read.parquet(folder)


def holds_identifier(text: Column) -> Column:
    """Whether the sweep changes the value: a pseudonym is another text than what it stands for."""
    return _may_hold(text, CODE_SIZE) & text.rlike(IDENTIFIER)


def identifier_tokens(value: str) -> Column:
    return F.when(_may_hold(F.col(value), CODE_SIZE), F.regexp_extract_all(value, F.lit(IDENTIFIER), F.lit(0)))


def needles(original: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct identifiers of the input, and its distinct names; other values never leave the scan."""
    if original.columns == VALUES:
        tokens = original.select(F.explode(identifier_tokens("_value")).alias("needle")).distinct()
        named = original.where(F.col("_column").isin(*schema.NAME_MASKS)).select(F.col("_value").alias("needle"))
        return tokens, named.where("needle <> ''").distinct()
    names = [c for c in string_columns(original) if c in schema.NAME_MASKS]
    held = F.flatten(F.array_compact(F.array(*[identifier_tokens(c) for c in string_columns(original)])))
    tokens = original.select(F.explode(F.array_distinct(held)).alias("needle")).distinct()
    named = original.select(F.explode(F.array(*[F.col(c) for c in names]).cast("array<string>")).alias("needle"))
    return tokens, named.where("needle <> ''").distinct()


def _each_once(values: DataFrame) -> DataFrame:
    """(column_name, value, row_count): other values of a column may have been made one by the sweep."""
    return values.groupBy(F.col("_column").alias("column_name"), F.col("_value").alias("value")).agg(F.sum("_rows").alias("row_count"))


def leak_scan(original: DataFrame, published: DataFrame) -> DataFrame:
    """Columns of the output that still hold an identifier of the input; either may be given as its `column_values`.

    Asked of the data, not of the code that cleaned it.  Shape-like needles are
    matched token to token and names anywhere in a value; both are equi-joins
    over distinct values, which are found once and kept in the checkpoint folder.
    Values with no identifier's shape and no piece of a name are left before the joins.
    Reports columns and counts, never a value.
    """
    ensure_checkpoint_dir(published.sparkSession)
    after = published if published.columns == VALUES else column_values(published)
    tokens, named = needles(original)
    named = named.checkpoint()
    shaped = _each_once(after.where(holds_identifier(F.col("_value"))))
    token_hits = (
        shaped.select("column_name", "value", "row_count", F.explode(F.array_distinct(identifier_tokens("value")))
                      .alias("needle")).join(tokens, "needle", "left_semi")
    )
    held = _each_once(narrowed(after, "_value", named, "needle")).checkpoint()
    name_hits = containing(held, "value", named, "needle").select(
        "column_name", "value", "row_count", "needle")
    return (
        token_hits.select("column_name", "value", "row_count").unionByName(
            name_hits.select("column_name", "value", "row_count")).distinct()
        .groupBy("column_name").agg(rows().alias("leaking_values"), F.sum("row_count").alias("leaking_rows"))
    )


def identifier_shapes(frame: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Identifier-shaped tokens in free text by shape, known published ones left out.

    Tokens are counted before the allow-list so a frequent one is handled once.
    """
    # A plain substring test spares most texts the expression search.
    found = F.array(*[
        F.struct(F.lit(name).alias("shape"), F.when(
            F.contains(F.col(text), F.lit(MARKERS[name])), F.regexp_extract_all(text, F.lit(ANY_SCRIPT + pattern), F.lit(0))
        ).alias("tokens")) for name, pattern in SHAPES.items()])
    return (
        frame.select(*keys, F.explode(found).alias("s"))
        .select(*keys, "s.shape", F.explode("s.tokens").alias("token"))
        .groupBy(*keys, "shape", "token").agg(rows().alias("n"))
        .where(~F.col("token").rlike(PUBLISHED) & ~F.col("token").contains("{"))
        .groupBy(*keys, "shape").agg(rows().alias("distinct_tokens"), F.sum("n").alias("matches"))
    )

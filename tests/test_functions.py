"""Building blocks against brute force."""

import random
import re
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.columns import apart
from ledgerloom.functions.joins import by_civil_day, lookup_join
from ledgerloom.functions.median import exact_median
from ledgerloom.functions.substrings import containing, narrowed
from ledgerloom.operators import derive, sanitise
from ledgerloom.operators.normalise import (
    canonical_columns, empty_string_report, empty_to_null, normalise_requirement, unify, with_provenance)
from ledgerloom.operators.snapshots import severity_of


@pytest.mark.parametrize("size", [1, 2, 7, 400])
def test_exact_median(spark, size):
    rng = random.Random(size)
    rows = [(key, Decimal(rng.randrange(-10**9, 10**9)).scaleb(-4) if size > 2 else Decimal(n))
            for key in ("USD", "EUR", None) for n in range(size)]
    # One key holds far more rows than the others, and many equal values.
    rows += [("USD", Decimal("5.0000"))] * (size * 3)
    frame = spark.createDataFrame(rows, "currency string, cost decimal(28,4)")
    got = {r["currency"]: r["m"] for r in exact_median(frame, ["currency"], "cost", "m").collect()}
    for key in ("USD", "EUR", None):
        assert got[key] == pytest.approx(float(statistics.median(v for k, v in rows if k == key)), abs=1e-9)


def test_exact_median_ignores_partitioning(spark):
    frame = spark.range(1000).select(F.lit("x").alias("k"), (F.col("id") * 7 % 991).cast("decimal(28,4)").alias("v"))
    values = {exact_median(frame.repartition(n), ["k"], "v", "m").first()["m"] for n in (1, 5, 13)}
    assert len(values) == 1


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_lookup_join_keeps_hot_keys_whole(spark, broadcast):
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        fact = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(
            F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"))
        lookup = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4)], "key string, v int")
        inner = lookup_join(fact, lookup, ["key"], ["id"])
        assert inner.count() == 1000 * 2 + 1 + 1000
        assert inner.columns == ["id", "key", "v"]
        assert lookup_join(fact, lookup, ["key"], ["id"], "left").count() == 2000 + 1000 + 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)


def test_by_civil_day(spark):
    frame = spark.sql("SELECT DATE'2024-02-28' AS s, DATE'2024-03-02' AS e UNION ALL SELECT DATE'2024-01-01', DATE'2024-01-01'")
    assert [str(r["day"]) for r in by_civil_day(frame, "s", "e").orderBy("day").collect()] == [
        "2024-02-28", "2024-02-29", "2024-03-01"]


def test_containing_equals_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 30))) for _ in range(120)]
    needles = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(40)})
    got = containing(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), "text",
                     spark.createDataFrame([(x,) for x in needles], "needle string"), "needle")
    assert {(r["n"], r["needle"]) for r in got.collect()} == {
        (n, x) for n, t in enumerate(texts) for x in needles if x in t}


def test_containing_long_texts_and_needles(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abé😀") for _ in range(n)) for n in (0, 7, 255, 256, 257, 1000, 3000)] + [None]
    needles = [t[i:i + n] for t in texts if t for i, n in ((0, 1), (250, 12), (251, 8), (240, 40), (600, 300), (1, 3)) if t[i:i + n]]
    needles += ["zz", "abzzzzzzzz", "", "é" * 30]
    got = containing(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), "text",
                     spark.createDataFrame([(x,) for x in needles], "needle string"), "needle")
    assert sorted((r["n"], r["needle"]) for r in got.collect()) == sorted(
        {(n, x) for n, t in enumerate(texts) for x in needles if t and x and x in t})


def test_narrowed_keeps_every_text_that_holds_a_needle(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abé😀") for _ in range(n)) for n in (0, 1, 7, 255, 256, 257, 1000, 3000)]
    texts += ["".join(rng.choice("0123-") for _ in range(12)) for _ in range(200)] + ["x" * 300 + "needle nine", None, "", "needle nine"]
    needles = ["needle nine", "3-12", "", None] + [t[i:i + n] for t in texts[:8] for i, n in ((0, 3), (250, 12), (600, 300)) if t[i:i + n]]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(3)
    kept = [r["n"] for r in narrowed(frame, "text", spark.createDataFrame([(x,) for x in needles], "needle string"), "needle").collect()]
    assert len(kept) == len(set(kept))
    assert set(kept) == {n for n, t in enumerate(texts) if t and any(x and x in t for x in needles)}
    assert narrowed(frame, "text", spark.createDataFrame([(None,), ("",)], "needle string"), "needle").count() == 0


GUID = "2B87f7b4-e1d9-35e4-fedc-338162c66672"


def test_pseudonyms_are_stable_and_shaped(spark):
    frame = spark.createDataFrame(
        [(f"/sub/{GUID}/x/{GUID}",), (f"{GUID}",), ("ABCD-1E2F-GH3-IJK end",), ("",), (None,), ("plain",)], "t string")
    rows = [r[0] for r in frame.select(sanitise.sanitise_text(F.col("t"))).collect()]
    import hashlib
    digest = hashlib.sha256(("ledgerloom" + GUID).encode()).hexdigest()
    fake = "-".join([digest[:8], digest[8:12], digest[12:16], digest[16:20], digest[20:32]])
    assert rows[0] == f"/sub/{fake}/x/{fake}" and rows[1] == fake
    code = hashlib.sha256("ledgerloomABCD-1E2F-GH3-IJK".encode()).hexdigest().upper()
    assert rows[2] == "-".join([code[:4], code[4:8], code[8:11], code[11:14]]) + " end"
    assert rows[3:] == ["", None, "plain"]


def test_sanitise_keeps_empty_strings_and_proof_finds_leaks(spark):
    frame = spark.createDataFrame(
        [(f"/sub/{GUID}", "Ada Example", "", f"owner Ada Example of {GUID}"), ("/sub/none", None, "", "clean")],
        "ResourceId string, BillingAccountName string, x_Empty string, note string")
    clean = sanitise.sanitise(frame)
    assert clean.where("x_Empty = ''").count() == 2
    leaks = {r["column_name"]: r["leaking_rows"] for r in sanitise.leak_scan(frame, clean).collect()}
    assert leaks == {"note": 1}  # the name survives inside free text, and the proof says so
    spared = sanitise.sanitise(frame, spare=("ResourceId",))
    assert {r["column_name"] for r in sanitise.leak_scan(frame, spared).collect()} == {"note", "ResourceId"}


@pytest.mark.parametrize("spare", [(), ("ResourceId",), ("BillingAccountName", "code"), ("ResourceId", "x_CustomerName", "note")])
def test_leak_scan_of_values_equals_that_of_rows(spark, spare):
    """A name that the mask holds, empty names, nulls, rows that come twice, two values that the sweep makes one."""
    swept = sanitise.pseudonym_guid(F.lit(GUID), sanitise.DEFAULT_SALT)
    same = spark.range(1).select(swept).first()[0]
    cells = [(f"/sub/{GUID}", "Account", "", "ABCD-1E2F-GH3-IJK", f"of {GUID} and Account", 1),
             (f"/sub/{GUID}", "", None, None, "", 2), (f"/sub/{same}", None, "Ada", "none", None, 3),
             ("Ada's /sub", "Account", "Ada", "ABCD-1E2F-GH3-IJK", f"of {GUID} and Account", 4),
             (None, "", "x", "x ABCD-1E2F-GH3-IJK x", "long " * 80 + "Ada", 5)]
    columns = ["ResourceId", "BillingAccountName", "x_CustomerName", "code", "note"]
    frame = spark.createDataFrame(cells * 2 + cells[:1], ", ".join(f"{c} string" for c in columns) + ", n int")
    published = sanitise.sanitise(frame, spare=spare)
    before, after = [[r.asDict() for r in f.collect()] for f in (frame, published)]
    tokens = {t for r in before for c in columns for t in re.findall(sanitise.IDENTIFIER, r[c] or "")}
    names = {r[c] for r in before for c in ("BillingAccountName", "x_CustomerName") if r[c]}
    expected = {}
    for c in columns:
        hits = [r[c] for r in after if r[c] and (tokens & set(re.findall(sanitise.IDENTIFIER, r[c])) or any(n in r[c] for n in names))]
        if hits:
            expected[c] = (len(set(hits)), len(hits))
    values = sanitise.column_values(frame)
    for original, layer in ((frame, published), (values, sanitise.sanitise(values, spare=spare)), (values, published)):
        assert {r["column_name"]: (r["leaking_values"], r["leaking_rows"]) for r in sanitise.leak_scan(original, layer).collect()} == expected


def test_sanitise_nested(spark):
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.StringType())),
                         T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
                         T.StructField("n", T.IntegerType())])
    frame = spark.createDataFrame([((["a", GUID], {"k": GUID}, 3),), (None,)], T.StructType([T.StructField("m", kind)]))
    first, second = [r[0] for r in frame.select(sanitise.sanitise_nested(F.col("m"), kind)).collect()]
    assert GUID not in str(first) and first["ids"][0] == "a" and first["n"] == 3 and second is None


def test_identifier_shapes(spark):
    text = ("mail ünal.x@mail.example.com /subscriptions/abc) acme.onmicrosoft.com "
            "00000000-0000-0000-0000-000000000000 {TEMPLATE}@x.yz a@b.cd a@b.cd")
    rows = {r["shape"]: (r["distinct_tokens"], r["matches"]) for r in sanitise.identifier_shapes(
        spark.createDataFrame([("d", text)], "k string, text string"), "text", ["k"]).collect()}
    assert rows["Azure subscription"] == (1, 1) and rows["tenant domain"] == (1, 1)
    assert "GUID" not in rows
    assert rows["email address"][1] == 4 or rows["email address"][1] == 3


def test_requirement_text(spark):
    frame = spark.createDataFrame([("  *A* [B c](#bc)  MUST  NOT be null..",), ("must be lower",), ("X MAY, and MUST.",)], "t string")
    rows = frame.select(normalise_requirement(F.col("t")), severity_of(F.col("t"))).collect()
    assert rows[0][0] == "A B c MUST NOT be null" and rows[0][1] == "FAIL"
    assert rows[1][1] is None and rows[2][1] == "FAIL"


def test_canonical_columns_by_presence(spark):
    frame = spark.createDataFrame([("root", "x", "only", "keep")], "SkuMeter string, x_SkuMeterName string, x_InvoiceId string, PricingCurrency string")
    row = canonical_columns(frame).first()
    assert (row["SkuMeter"], row["InvoiceId"], row["PricingCurrency"], row["SkuPriceDetails"]) == ("root", "only", "keep", None)


def test_merge_boundary(spark):
    a = with_provenance(spark.createDataFrame([("", "1")], "SkuId string, Tags string"), True, "1.2", "a")
    b = with_provenance(spark.createDataFrame([("z",)], "SkuId string"), False, "1.0r2", "b")
    rows = {r["x_FixtureId"]: r for r in unify([a, b]).collect()}
    assert rows["a"]["SkuId"] is None and rows["b"]["Tags"] is None
    counts = {r["column_name"]: r["empty_strings"] for r in empty_string_report(a).collect()}
    assert counts["SkuId"] == 1
    empty = empty_to_null(a.limit(0))
    assert empty.count() == 0 and empty.columns == a.columns  # a drop with no rows is a valid state


def test_fingerprint_ignores_order_and_partitions(spark):
    frame = spark.range(500).select(F.col("id"), (F.col("id") % 7).cast("string").alias("v"), F.lit("k").alias("era"))
    prints = {tuple(derive.content_fingerprint(f, ["era"]).first()) for f in (
        frame, frame.repartition(7), frame.orderBy(F.desc("id")))}
    assert len(prints) == 1
    changed = derive.content_fingerprint(frame.withColumn("v", F.lit("other")), ["era"]).first()
    assert tuple(changed) not in prints


@pytest.mark.parametrize(("amounts", "middle"), [
    (["0.00001", "0.00002", "0.00003", "0.001234", "0.004"], 0.00003),
    (["1000000000000000000", "-5", "-0.5", "0"], -0.25),
    (["-0.000000000000000003", "-1.5", "-2"], -1.5),
])
def test_exact_median_rounds_nothing(spark, amounts, middle):
    frame = spark.createDataFrame([("k", Decimal(a)) for a in amounts], "k string, v decimal(38,18)")
    assert exact_median(frame, ["k"], "v", "m").first()["m"] == middle


def test_apart_gives_the_same_rows_and_schema(spark):
    frame = spark.sql("SELECT * FROM VALUES (1, 'a'), (2, NULL), (NULL, '') AS t(n, s)")
    made = {"n": F.col("n"), "more": F.concat("s", F.lit("!")), "fixed": F.lit("x"), "null": F.lit(None).cast("string")}
    plain = frame.select(*[c.alias(name) for name, c in made.items()])
    for through in (None, ["more"], ["fixed"]):
        found = apart(frame, made, through)
        assert found.schema == plain.schema and sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_frame_replacement_is_that_of_single_values(spark):
    guid, other, code = "0a1B2c3D-0000-4000-8000-00000000abcd", "11111111-2222-3333-4444-555555555555", "AB12-CD34-EF5-GH6"
    texts = [None, "", "none", guid, f"x{guid}", f"{guid}{other}", f"{guid}-{guid[9:]}", f"/a/{guid}/b/{other}/c", f"é{guid}", f"😀 {guid} 😀 {code}",
             code, f"X{code} {code}", f"{code}9 {code}", f"{code}-{code}", f"é{code}", f"{code} {guid} {code}", "a-long-value-without-any-identifier-in-it",
             "aaaaaaaa-aaaa-aaaa-aaaa-aaaaaaaaaaaa-aaaa-aaaa-aaaa-aaaaaaaaaaaa"]
    frame = spark.createDataFrame([(n, t, t) for n, t in enumerate(texts)], "n int, a string, b string")
    for whole, single in ((sanitise.with_guids_replaced, sanitise.pseudonymise_guids), (sanitise.with_codes_replaced, sanitise.pseudonymise_codes)):
        got = whole(frame, ["a"]).orderBy("n").collect()
        assert got[0].asDict().keys() == {"n", "a", "b"} and [r["b"] for r in got] == texts
        assert [r["a"] for r in got] == [r[0] for r in frame.orderBy("n").select(single(F.col("a"))).collect()]
    assert whole(frame, ["b"]).where("b <> a").count() >= 5


def test_one_identifier_is_replaced_without_a_lambda(spark):
    """The lambda, and the expression compiled for each value, are left for values of several identifiers."""
    frame = spark.createDataFrame([("/a/11111111-2222-3333-4444-555555555555",)], "a string")
    plan = sanitise.with_guids_replaced(frame, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "regexp_instr" in plan and plan.index("regexp_instr") > plan.index("zip_with")

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from steward.functions import text as tx
from steward.functions.cells import classify_cell, normalize_value
from steward.functions.jsontext import canonical_json, is_json_object
from steward.functions.masking import mask_by_classification
from steward.functions.naming import alias_columns, to_camel, to_snake
from steward.functions import paths as ps
from steward.schemas import RAW_CELLS
from steward.sources.grid import melt_to_cells

TEXTS = [
    "  plain  text ", "tab\tand\nnewline", "\u00a0no\u3000break\u2003wide\u2028line",
    "\x1cfile\x1fsep\x85nel", "", "   ", "ünïcode  Ångström", "zero\u200bwidth",
]


def test_whitespace_digest_and_length(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select(
        "t", tx.digest_text(F.col("t")).alias("d"), tx.normalized_length(F.col("t")).alias("n"),
        tx.strip(F.col("t")).alias("s"),
    ).collect()
    for row in got:
        want = re.sub(r"\s+", " ", row.t.strip())
        assert row.d == hashlib.sha256(want.encode()).hexdigest()
        assert row.n == len(want)
        assert row.s == row.t.strip()


def test_whole_string_match_rejects_trailing_newline(spark):
    df = spark.createDataFrame([("ab",), ("ab\n",), ("xab",)], "t string")
    assert [r.m for r in df.select(tx.matches("t", "[a-b]+").alias("m")).collect()] == [
        True, False, False,
    ]


@pytest.mark.parametrize(
    ("path", "escapes"),
    [("a/b.txt", False), ("/a", True), ("C:\\a", True), ("c:/a", True), ("C:a", False),
     ("\\\\server\\share", True), ("a/../b", True), ("a\\..\\b", True), ("a/..b", False)],
)
def test_path_guard(spark, path, escapes):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(ps.escapes_base("p").alias("x")).head().x is escapes


def test_segments_and_location(spark):
    df = spark.createDataFrame(
        [("/a/b", "/a/b/c"), ("/a/b", "/a/bc"), ("/a/b", "/a//b"), ("/", "/x"), ("/a/b", "/a"),
         ("/a/b", "/a/b/../../etc"), ("/a/b", "/a/b/x/../y"), ("/a/x/../b", "/a/b/c"), ("/a/b", "/../../a/b")],
        "root string, path string",
    )
    inside = df.select(F.expr(ps.lies_under_sql("path", "root")).alias("x")).collect()
    assert [r.x for r in inside] == [True, False, True, True, False, False, True, True, True]


def test_finding_paths(spark):
    df = spark.createDataFrame([(2, 7, 3)], "s int, r int, c int")
    row = df.select(ps.cell_path(F.col("s"), F.col("r"), F.col("c")).alias("p")).head()
    assert row.p == "$.sheets.2.rows.7.columns.3"
    parsed = spark.createDataFrame([(row.p,), ("$.workbook",), (None,)], "p string").select(
        ps.sheet_ordinal_from_path(F.col("p")).alias("s")
    )
    assert [r.s for r in parsed.collect()] == [2, None, None]
    loc = spark.createDataFrame([(["a", "0", "b"],), ([],)], "l array<string>")
    assert [r.p for r in loc.select(ps.loc_to_path(F.col("l")).alias("p")).collect()] == [
        "$.a.0.b", "$",
    ]


def test_classify_priority(spark):
    cases = [
        ("n", False, None, None, None, "blank"), ("f", False, "=A1", None, None, "formula"),
        ("e", False, "#N/A", None, None, "error"), ("b", False, None, None, True, "boolean"),
        ("n", True, None, 43831.0, None, "date"), ("n", False, None, 1.0, None, "number"),
        ("inlineStr", False, "x", None, None, "inline_string"), ("s", True, "x", None, None, "string"),
        ("str", False, "x", None, None, "string"), ("zz", False, "x", None, None, "unknown"),
    ]
    data = [("W", 0, 1, i, k, d, t, n, b, None) for i, (k, d, t, n, b, _) in enumerate(cases)]
    df = spark.createDataFrame(data, RAW_CELLS).orderBy("column_ordinal")
    got = df.select(classify_cell().alias("k"), classify_cell(fold_inline=True).alias("f")).collect()
    assert [r.k for r in got] == [c[-1] for c in cases]
    assert [r.f for r in got][6] == "string"


VALUE_CASES = [
    ("string", "string", " TEST-TRIM ", None, None, "TEST-TRIM", None),
    ("string", "string", "   ", None, None, None, None),
    ("number", "number", None, 12.5, None, 12.5, None),
    ("integer", "number", None, 10.0, None, 10, None),
    ("integer", "number", None, 2.5, None, None, "VALUE_TYPE_MISMATCH"),
    ("integer", "number", None, 1e300, None, None, "VALUE_TYPE_MISMATCH"),
    ("integer", "string", "5", None, None, None, "VALUE_TYPE_MISMATCH"),
    ("number", "boolean", None, None, True, None, "VALUE_TYPE_MISMATCH"),
    ("boolean", "boolean", None, None, True, True, None),
    ("number", "formula", "=A1", None, None, None, "FORMULA_VALUE_PROHIBITED"),
    ("string", "error", "#N/A", None, None, None, "ERROR_CELL_PROHIBITED"),
    ("string", "unknown", "x", None, None, None, "UNKNOWN_CELL_TYPE"),
    ("date", "number", None, 1.0, None, None, "VALUE_TYPE_MISMATCH"),
    ("date", "blank", None, None, None, None, None),
]


def test_normalize_value(spark):
    df = spark.createDataFrame(
        [(i, *c[:5], None) for i, c in enumerate(VALUE_CASES)],
        "i int, value_type string, cell_type string, value_string string, value_number double, "
        "value_boolean boolean, value_timestamp timestamp",
    )
    got = df.select("i", normalize_value(F.col("value_type")).alias("v")).orderBy("i").collect()
    for row, case in zip(got, VALUE_CASES, strict=True):
        assert row.v.reject_code == case[-1], case
        assert row.v[f"value_{case[0]}"] == case[-2], case


def test_json_shapes(spark):
    texts = ['{"a":1}', ' {"a":1} ', '{"a":1} x', "{}] x", '{}} x', '{"a":1,"b"', "[1]", "1", "null",
             '"t"', "", '{"a":1,"a":2}', '{"a":1},{"b":2}', None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [bool(r.o) for r in df.select(is_json_object(F.col("t")).alias("o")).collect()]
    assert got == [True, True, False, False, False, False, False, False, False, False, False,
                   True, False, False]


def test_canonical_json_sorts_keys_and_keeps_nulls(spark):
    df = spark.createDataFrame([("한글", None, 1)], "z string, m string, a int")
    assert df.select(canonical_json(df).alias("j")).head().j == '{"a":1,"m":null,"z":"한글"}'


def test_canonical_json_sorts_nested_keys(spark):
    df = spark.sql("""select named_struct('z', 1, 'a', named_struct('y', 2, 'b', cast(null as int))) as s,
        array(named_struct('k', 1, 'c', 2), null) as l, map('q', named_struct('n', 1, 'm', 2), 'd', null) as m,
        cast(null as struct<b:int,a:int>) as n""")
    text = df.select(canonical_json(df).alias("j")).head().j
    assert text == ('{"l":[{"c":2,"k":1},null],"m":{"d":null,"q":{"m":2,"n":1}},"n":null,'
                    '"s":{"a":{"b":null,"y":2},"z":1}}')


def test_numbers_that_a_double_would_round(spark):
    df = spark.sql("""select 'W' as workbook_id, 0 as sheet_ordinal, r as row_ordinal, b, d from values
        (1L, 9007199254740993L, cast(12345678901234567.89 as decimal(20,2))),
        (2L, 9007199254740992L, cast(12.25 as decimal(20,2))), (3L, null, null), (4L, -9223372036854775807L, cast(7 as decimal(20,2)))
        as t(r, b, d)""")
    cells = melt_to_cells(df, ["b", "d"])
    got = cells.select("row_ordinal", "column_ordinal", "cell_type", normalize_value(F.lit("integer")).alias("i"),
                       normalize_value(F.lit("number")).alias("n")).collect()
    value = {(r.row_ordinal, r.column_ordinal): (r.i.value_integer, r.i.reject_code, r.n.value_number, r.n.reject_code) for r in got}
    bad = "VALUE_TYPE_MISMATCH"
    assert value[1, 1] == (9007199254740993, None, None, bad)
    assert value[2, 1] == (9007199254740992, None, 9007199254740992.0, None)
    assert value[4, 1] == (-9223372036854775807, None, None, bad)
    assert value[1, 2] == (None, bad, None, bad) and value[2, 2] == (None, bad, 12.25, None) and value[4, 2] == (7, None, 7.0, None)
    assert value[3, 1] == value[3, 2] == (None, None, None, None)


def test_masking(spark):
    df = spark.createDataFrame(
        [("public",), ("internal",), ("confidential",), ("secret",), (None,)], "c string"
    )
    got = [r.v for r in df.select(mask_by_classification(F.lit("Ab1"), F.col("c")).alias("v")).collect()]
    assert got == ["Ab1", "Xxn", hashlib.sha256(b"Ab1").hexdigest(), None, None]


def test_alias_columns(spark):
    assert to_camel("human_review_required") == "humanReviewRequired"
    assert to_snake("humanReviewRequired") == "human_review_required"
    df = spark.createDataFrame(
        [(1, [(2,)], "x")], "rule_id int, evidence_refs array<struct<ref_id:int>>, ruleName string"
    )
    camel = alias_columns(df)
    assert camel.columns == ["ruleId", "evidenceRefs", "ruleName"]
    assert camel.schema["evidenceRefs"].dataType.elementType.names == ["refId"]
    both = spark.createDataFrame([(None, "y")], "ruleId string, rule_id string")
    assert alias_columns(both, "snake").collect()[0].rule_id == "y"

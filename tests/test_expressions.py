"""The filter language: vectors for every operator and every rule about values."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilesieve.functions import values as V
from tilesieve.plans.expressions import Context, ExpressionError, compile_expression, parse

SLOTS = ["string_value", "float_value", "double_value", "int_value", "uint_value", "sint_value", "bool_value"]


def tag(**slot):
    return tuple(slot.get(s) for s in SLOTS)


def tags_frame(spark, tags):
    return spark.createDataFrame([(1,)], "one int").select(
        F.map_from_arrays(
            F.array(*map(F.lit, tags)),
            F.array(*(F.from_json(F.lit("{}"), V.MVT_VALUE) if not any(v is not None for v in t) else F.struct(*(F.lit(v).cast(k).alias(s) for v, s, k in zip(t, SLOTS, ("string", "float", "double", "bigint", "decimal(20,0)", "bigint", "boolean")))) for t in tags.values())).cast(f"array<{V.MVT_VALUE}>"),
        ).alias("tags")
    )


TAGS = {
    "title": tag(string_value="Low Harbour Beacon"),
    "class": tag(string_value="beacon"),
    "height": tag(double_value=27.25),
    "lit": tag(bool_value=True),
    "range": tag(sint_value=42),
    "f32": tag(float_value=0.3),
    "five": tag(int_value=5),
    "five_text": tag(string_value="5"),
    "five_float": tag(double_value=5.0),
    "wrapped": tag(uint_value=str(2**64 - 1)),
    "nan": tag(double_value=float("nan")),
    "zero": tag(double_value=0.0),
    "minus_zero": tag(double_value=-0.0),
    "blank": tag(string_value=""),
    "huge": tag(double_value=1e21),
    "tiny": tag(double_value=1.5e-7),
    "unset": tag(),
    "several": tag(string_value="s", int_value=3),
}

G = lambda name: ["tag", name]
#: Drops labels but for the plain one and those in two languages; a group that takes no part is null.
KEY_RULE = ["any", ["starts-with", ["key"], "old:"], ["all", ["regex-match", ["key"], "^label"], ["none", ["in", ["regex-capture", ["key"], r"^label(?:\.(.*))?$", 1], ["literal", [None, "de", "fr"]]]]]]

CASES = [
    (KEY_RULE, True),
    (["regex-match", G("title"), "[A-Z][a-z]+ B"], True),
    (["==", ["regex-capture", G("title"), r"(\w+) (\w+)$", 1], "Harbour"], True),
    (["none", ["==", G("class"), "buoy"], ["<", G("range"), 42]], True),
    (["all", ["boolean", G("lit")], [">=", G("height"), 27], ["<=", G("height"), 27.25]], True),
    (["any", ["ends-with", G("title"), "harbour"], ["starts-with", G("class"), "bea"]], True),
    (["not", ["in", G("class"), ["literal", ["Beacon", "wreck", 7]]]], True),
    (["in", None, ["literal", [None, "a"]]], True),
    (["in", G("class"), ["literal", ["wreck", "beacon"]]], True),
    (["!=", G("class"), G("title")], True),
    (["<", G("class"), G("title")], False),
    (["!=", ["type"], "LineString"], True),
    (["all", [">", G("range"), 41.5], ["all", ["!", ["==", G("depth"), 0]], ["==", G("lit"), True]]], True),
    (["any", ["!=", G("lit"), True], ["none", ["any"]]], True),
    (["ends-with", ["key"], ".en"], True),
    (["==", G("depth"), "deep"], False),
    # null is a value below all others
    (["==", G("nowhere"), None], True),
    (["<", G("nowhere"), -5], True),
    (["<=", G("nowhere"), "a"], True),
    (["!=", G("nowhere"), 0], True),
    ([">=", G("nowhere"), 0], False),
    (["<", None, False], True),
    ([">=", None, None], True),
    (["<", False, True], True),
    # numbers
    (["==", G("five"), 5.0], True),
    (["==", G("five_float"), 5], True),
    (["==", G("f32"), 0.3], True),
    (["==", G("wrapped"), -1], True),
    (["==", G("nan"), 7], True),
    (["<", G("nan"), 7], False),
    (["<=", G("nan"), G("five")], True),
    (["==", G("several"), "s"], True),
    (["==", G("unset"), None], True),
    # other mixtures by display form
    (["==", G("five"), "5"], True),
    (["==", G("five_float"), "5"], True),
    (["==", G("lit"), "true"], True),
    (["<", 10, "9"], True),
    (["==", G("huge"), "1000000000000000000000"], True),
    (["==", G("tiny"), "0.00000015"], True),
    (["==", G("minus_zero"), "-0"], True),
    (["==", ["literal", ["a", 1, None]], "[a, 1, null]"], True),
    (["==", ["literal", {"a": 1}], '{"a":1}'], True),
    # membership doesn't convert
    (["in", G("five"), ["literal", ["5", 5.0, True]]], False),
    (["in", G("five"), ["literal", [5]]], True),
    (["in", G("five_float"), ["literal", [5.0]]], False),
    (["in", G("height"), ["literal", [27.25]]], True),
    (["in", G("nowhere"), ["literal", ["null", 0, False]]], False),
    (["in", G("lit"), ["literal", [True]]], True),
    (["in", ["literal", [1, "a"]], ["literal", [[1, "a"]]]], True),
    (["in", ["literal", [1, "a"]], ["literal", [[1.0, "a"], 1]]], False),
    # what counts as true
    (["boolean", G("zero")], False),
    (["boolean", G("minus_zero")], True),
    (["boolean", G("nan")], True),
    (["boolean", G("blank")], False),
    (["boolean", G("unset")], False),
    (["boolean", ["literal", []]], False),
    (["boolean", ["literal", [0]]], True),
    (["boolean", ["literal", 0.0]], False),
    (["boolean", ["literal", "0"]], True),
    (G("class"), True),
    (["any"], False),
    (["all"], True),
    (["none"], True),
    (["none", False, 0, ""], True),
    # text operators take any value
    (["starts-with", G("nowhere"), "nu"], True),
    (["ends-with", G("lit"), "ue"], True),
    (["starts-with", G("five_float"), "5"], True),
    (["regex-match", G("range"), "^[4]2$"], True),
    # patterns
    (["regex-match", ["literal", "abc\n"], "abc$"], False),
    (["regex-match", ["literal", "a\rb"], "a.b"], True),
    (["regex-match", ["literal", "é"], r"^\w$"], True),
    (["regex-match", ["literal", "x]y"], "[]]"], True),
    (["==", ["regex-capture", ["literal", "key=val"], "(?P<k>[a-z]+)=(?P<v>.*)", 2], "val"], True),
    (["==", ["regex-capture", ["literal", "zzz"], "a(b)", 1], None], True),
    (["==", ["regex-capture", ["literal", "ab"], "a(b)", 2], None], True),
    (["==", ["regex-capture", ["literal", "a"], "a(b)?", 1], None], True),
    (["==", ["regex-capture", ["literal", "a"], "a(b?)", 1], ""], True),
    (["==", ["regex-capture", ["literal", "b"], "(a)|(b)", 1], None], True),
    (["==", ["regex-capture", ["literal", "b"], "(a)|(b)", 2], "b"], True),
    (["==", ["regex-capture", ["literal", "ab"], "a(b)", 1, "more"], "b"], True),
    (["regex-match", ["literal", "Ünder"], r"^\p{L}+$"], True),
    (["regex-match", ["literal", "Ünder7"], r"^\p{Letter}+$"], False),
    (["regex-match", ["literal", "αβγ"], r"^\p{Greek}{3}$"], True),
    (["regex-match", ["literal", "aβ"], r"^\p{^Greek}\P{Lu}$"], True),
    (["regex-match", ["literal", "fF09"], "^[[:xdigit:]]+$"], True),
    (["regex-match", ["literal", "é"], "^[[:alpha:]]$"], False),
    (["regex-match", ["literal", "é_9"], "^[[:^alpha:]_]+$"], True),
    (["regex-match", ["literal", "A"], r"^\x{41}$"], True),
    (["regex-match", ["literal", "aÉ"], "a(?i:é)"], True),
    (["regex-match", ["literal", "é"], r"^(?-u:\w)$"], False),
    (["regex-match", ["literal", "a\nb"], "a(?s:.)b"], True),
    (["==", ["regex-capture", ["literal", "éx"], r"^(\p{L})?x", 1], "é"], True),
    (["==", ["regex-capture", ["literal", "x"], r"^(\p{L}-)?x", 1], None], True),
    (["==", ["regex-capture", ["literal", "x"], "^(a)?[$x]", 1], None], True),
    (["==", ["regex-capture", ["literal", "b ab"], "(a)?b", 1], None], True),
    (["==", ["regex-capture", ["literal", "b"], "(a*)?b", 1], ""], True),
    (["==", ["regex-capture", ["literal", "xyz"], "(?P<n>(q)|y)z", 2], None], True),
]


def test_vectors(spark):
    df = tags_frame(spark, TAGS)
    c = Context.of_map(F.col("tags"), F.lit("label.en"), F.lit("Polygon"))
    row = df.select(*(compile_expression(doc, c).alias(f"c{i}") for i, (doc, _) in enumerate(CASES))).first()
    wrong = [(doc, row[i], want) for i, (doc, want) in enumerate(CASES) if row[i] is not want]
    assert not wrong


def test_keys(spark):
    keys = {"label.en": True, "label.de": False, "label": False, "label.": True, "old:label": True, "class": False, "labels": False}
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k: r.hit for r in df.select("k", compile_expression(KEY_RULE, Context(lambda _: V.null(), F.col("k"))).alias("hit")).collect()}
    assert got == keys


def test_never_null(spark):
    """Whatever is missing, a condition is true or false."""
    typed = spark.createDataFrame([(None, None, None, None)], "s string, n long, f double, b boolean")
    c = Context.of_columns({"s": V.STR, "n": V.INT, "f": V.FLOAT, "b": V.BOOL})
    docs = [[op, G(a), x] for op in ("==", "!=", "<", ">", "<=", ">=") for a in "snfb" for x in (None, True, 1, 1.5, "x", G("s"), G("n"), G("f"), G("b"))]
    docs += [[op, G(a), "x"] for op in ("starts-with", "ends-with", "regex-match") for a in "snfb"] + [["boolean", G(a)] for a in "snfb"] + [["in", G(a), ["literal", [1, 1.5, "x", True]]] for a in "snfb"]
    row = typed.select(*(compile_expression(d, c).alias(f"c{i}") for i, d in enumerate(docs))).first()
    assert None not in tuple(row)
    empty = tags_frame(spark, {"s": tag()}).select(*(compile_expression(d, Context.of_map(F.col("tags"))).alias(f"c{i}") for i, d in enumerate(docs))).first()
    assert tuple(empty) == tuple(row)


def test_each_tag_is_looked_up_once():
    """However often a rule's values are compared with one another, a tag in a map costs one lookup."""
    c = Context.of_map(F.col("tags"))
    for doc, n in ((["==", G("a"), G("b")], 2), (["==", G("a"), "x"], 1), ([">", G("a"), 5], 1), (["all", ["<", G("a"), 1], ["in", G("a"), ["literal", [1, "x"]]], ["!=", G("b"), None]], 2)):
        assert compile_expression(doc, c)._jc.toString().count("try_element_at") == n


def test_numbers_as_they_are_printed():
    want = {1e20: "1e20", 1e-7: "1e-7", 1.5e-5: "0.000015", -1e-5: "-0.00001", 2.5e-6: "2.5e-6", 1e16: "1e16", 1e15: "1000000000000000.0", 0.0001: "0.0001", 1.25e300: "1.25e300", -3.0: "-3.0", 7: "7"}
    assert {x: V.number_text(x) for x in want} == want


def test_infinite_numbers():
    for doc in ([">", 1, float("inf")], ["literal", [1, float("-inf")]], float("nan")):
        with pytest.raises(ExpressionError):
            parse(doc)


@pytest.mark.parametrize(
    "doc",
    [[], [1, 2], ["invalid-op"], {"a": 1}, ["==", 1], ["==", 1, 2, 3], ["not"], ["in", 1, ["quay"]], ["in", 1, ["literal", "x"]], ["in", 1, 2], ["starts-with", "a", ["tag", "b"]], ["ends-with", "a", 1], ["regex-match", "a", 1], ["regex-match", "a", "["], ["regex-match", "a", "(?=x)"], ["regex-match", "a", r"(a)\1"], ["regex-match", "a", "a++"], ["regex-capture", "a", "b"], ["regex-capture", "a", "b", -1], ["regex-capture", "a", "b", 1.0], ["regex-capture", "a", "b", True], ["tag", 1], ["tag"], ["key", 1], ["type", "x"], ["literal"], ["not-in", 1, ["literal", [1]]], ["string", 1], ["any", ["nope"]]],
)
def test_errors(spark, doc):
    with pytest.raises(ExpressionError):
        parse(doc)


def test_error_texts():
    with pytest.raises(ExpressionError, match="Expected 2 arguments, got 1"):
        parse(["==", 1])
    with pytest.raises(ExpressionError, match="Expected at least 3 arguments, got 2"):
        parse(["regex-capture", "a", "b"])
    with pytest.raises(ExpressionError, match="string"):
        parse(["string", 1])


def test_extensions(spark):
    df = spark.createDataFrame([(5,)], "n long")
    c = Context.of_columns({"n": V.INT})
    assert tuple(df.select(compile_expression(["not-in", G("n"), ["literal", [5]]], c, True).alias("a"), compile_expression(["==", ["string", G("n")], "5"], c, True).alias("b")).first()) == (False, True)


def test_string_equality_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", 1)], T.StructType([T.StructField("s", T.StringType()), T.StructField("n", T.LongType())])).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").where(compile_expression(["==", G("s"), "a"], Context.of_columns({"s": V.STR}))).select("s")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualNullSafe(s,a)" in plan and "ReadSchema: struct<s:string>" in plan

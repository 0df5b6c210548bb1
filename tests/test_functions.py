import pytest
from pyspark.sql import functions as F

from quadloom.functions import dates, numbers, templates, terms, values
from quadloom.functions.values import Datatype


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


@pytest.mark.parametrize("text,base,pattern,decimal,group,ok,lex", [
    ("12", "integer", None, ".", None, True, "12"), ("+007", "integer", None, ".", None, True, "7"), ("1.5", "integer", None, ".", None, False, None), ("128", "byte", None, ".", None, False, None),
    ("-1", "unsignedInt", None, ".", None, False, None), ("18446744073709551615", "unsignedLong", None, ".", None, True, "18446744073709551615"), ("1e400", "double", None, ".", None, True, "INF"),
    ("1.50", "decimal", None, ".", None, True, "1.5"), ("NaN", "double", None, ".", None, True, "NaN"), ("INF", "decimal", None, ".", None, False, None), ("25%", "double", None, ".", None, True, "0.25"),
    ("1.234,50", "double", "#,##0.00", ",", ".", True, "1234.5"), ("12.34,50", "double", "#,##0.00", ",", ".", False, None), ("12,34,567", "integer", "#,##,##0", ".", ",", True, "1234567"),
    ("5", "integer", "00", ".", None, False, None), ("+5", "integer", "+0", ".", None, True, "5"), ("1.5E2", "double", "#0.###E#0", ".", None, True, "150"), ("1e21", "double", None, ".", None, True, "1e+21"), ("0.0000001", "double", None, ".", None, True, "1e-7"),
    ("123456789.5", "double", None, ".", None, True, "123456789.5"), ("-0", "double", None, ".", None, True, "-0"), ("", "integer", None, ".", None, False, None),
])
def test_numbers(spark, text, base, pattern, decimal, group, ok, lex):
    good, out, _ = numbers.check(F.lit(text), base, pattern, decimal, group)
    got = one(spark, good, out)
    assert got[0] is ok
    if ok:
        assert got[1] == lex


@pytest.mark.parametrize("value,pattern,want", [(1234567.891, "#,##0.00", "1,234,567.89"), (1234567.0, "#,##,##0", "12,34,567"), (0.5, "0%", "50%"), (-2.5, "0.0##", "-2.5"), (7.0, "000", "007"), (12.0, "+0", "+12"), (0.0, "#0.0", "0.0"), (2.5, "0", "2")])
def test_show_number(spark, value, pattern, want):
    assert one(spark, numbers.show(F.lit(value), pattern)) == (want,)


@pytest.mark.parametrize("text,base,pattern,ok,lex", [
    ("2010-10-18", "date", None, True, "2010-10-18"), ("10/18/2010", "date", "M/d/yyyy", True, "2010-10-18"), ("2010-02-30", "date", None, False, None), ("2010-10-18Z", "date", None, True, "2010-10-18Z"),
    ("2014-04-12T19:30", "dateTime", "yyyy-MM-ddTHH:mm", True, "2014-04-12T19:30:00"), ("193000", "time", "HHmmss", True, "19:30:00"), ("12:00:00.500+0100", "time", "HH:mm:ss.SSS XX".replace(" ", ""), True, "12:00:00.5+01:00"),
    ("2014-04-12T19:30:00+02:00", "dateTimeStamp", None, True, "2014-04-12T19:30:00+02:00"), ("2014-04-12T19:30:00", "dateTimeStamp", None, False, None), ("x", "date", None, False, None), ("25:00:00", "time", None, False, None),
])
def test_dates(spark, text, base, pattern, ok, lex):
    good, out = dates.check(F.lit(text), base, pattern)
    got = one(spark, good, out)
    assert got[0] is ok
    if ok:
        assert got[1] == lex


def test_instants_and_durations(spark):
    a, b = dates.instant(F.lit("2014-04-12T19:30:00+02:00"), "dateTime"), dates.instant(F.lit("2014-04-12T17:30:00Z"), "dateTime")
    assert one(spark, a == b, dates.instant(F.lit("2014-04-12"), "date") < dates.instant(F.lit("2014-04-13"), "date")) == (True, True)
    assert one(spark, dates.duration_seconds(F.lit("P1DT2H3M4.5S")), dates.duration_seconds(F.lit("-P1M"))) == (93784.5, -30.4375 * 86400)
    assert one(spark, dates.show(F.lit("2010-01-08T05:06:07.5Z"), "dateTime", "d.M.yyyy HH:mm:ss.SSSX")) == ("8.1.2010 05:06:07.500Z",)


@pytest.mark.parametrize("template,want", [("{x}", "a%20b%2Fc"), ("{+x}", "a%20b/c"), ("{#x}", "#a%20b/c"), ("{/x,y}", "/a%20b%2Fc/1"), ("{?x,y}", "?x=a%20b%2Fc&y=1"), ("{;y,e}", ";y=1;e"), ("{.y}", ".1"), ("{&y}", "&y=1"), ("{x:1}", "a"), ("{l}", "1,2"), ("{l*}", "1,2"), ("{/l*}", "/1/2"), ("{?l*}", "?l=1&l=2"), ("{none}", ""), ("p{n}q", "pq")])
def test_templates(spark, template, want):
    v = {"x": F.lit("a b/c"), "y": F.lit("1"), "e": F.lit(""), "l": F.array(F.lit("1"), F.lit("2")), "n": F.lit(None).cast("string")}
    assert one(spark, templates.expand(template, v, {"l"})) == (want,)


def test_template_iris(spark):
    v = {"x": F.lit("é b")}
    t = "http://ex.org/t.csv"
    assert one(spark, templates.to_iri("#r-{x}", t, v), templates.to_iri("schema:{x}", t, v), templates.to_iri("HTTP://Ex.org:80/{x}", t, v), templates.to_iri("{x}", t, {"x": F.lit("a")})) == (
        "http://ex.org/t.csv#r-é%20b", "http://schema.org/é%20b", "http://ex.org/é%20b", "http://ex.org/t.csva")
    assert templates.inverse("http://e/{a}/{b}", t, "b") and templates.inverse("http://e/{a}", t, "z") is None
    with pytest.raises(ValueError):
        templates.parse("{a")


def test_terms(spark):
    assert terms.common_ancestor(["byte", "positiveInteger"]) == "integer" and terms.common_ancestor(["date", "integer"]) == "anyAtomicType" and terms.common_ancestor(["token"]) == "token"
    assert one(spark, terms.expand_iri_column(F.lit("dc:title")), terms.expand_iri_column(F.lit("http://x"))) == ("http://purl.org/dc/terms/title", "http://x")
    assert terms.is_language_tag("de-CH") and not terms.is_language_tag("not a tag")


@pytest.mark.parametrize("text,dt,ok", [("token", Datatype("NMTOKEN", length=5), True), ("0FB7", Datatype("hexBinary", length=2), True), ("0FB", Datatype("hexBinary"), False), ("abc", Datatype("string", format="^b"), False), ("5", Datatype("integer", bounds={"maxExclusive": "5"}), False),
                                        ("NaN", Datatype("double", bounds={"maxExclusive": "5"}), True), ("2020-01-01", Datatype("date", bounds={"minInclusive": "2020-01-01"}), True), ("P1Y", Datatype("dayTimeDuration"), False), ("Y", Datatype("boolean", format="Y|N"), True), ("true", Datatype("boolean", format="Y|N"), False)])
def test_facets(spark, text, dt, ok):
    assert one(spark, values.check(F.lit(text), dt)[0]) == (ok,)


def test_numbers_beyond_the_decimal_range_and_hash_patterns(spark):
    from pyspark.sql import functions as F

    from quadloom.functions import numbers

    show = lambda x, p: spark.range(1).select(numbers.show(F.lit(x).cast("double"), p).alias("v")).first().v
    assert show(0.0, "#") == "0" and show(0.1, "#.0") == "0.1" and show(0.0, "#0.###E#0") == "0E00" and show(101.0, "#0.###E#0") == "1.01E02"
    assert show(1e21, "#,##0.0").startswith("1,000,000,000,000,000,000,000.0") and show(1e300, "0.0") == "1e+300"


def test_a_slash_in_a_middle_value_makes_a_reserved_variable(spark):
    from quadloom.operators import infer

    rows = [("iri", f"http://ex.org/x/{k}", "http://ex.org/p", "literal", "v", None, None, None) for k in ("a", "b/c", "d")]
    q = spark.createDataFrame(rows, "s_kind string, s string, p string, o_kind string, o string, o_dt string, o_lang string, g string")
    assert infer.infer(q)["tables"][0]["tableSchema"]["columns"][0]["aboutUrl"] == "{+subject_id}"


def test_usual_whole_numbers_and_days_need_no_pattern(spark):
    """The short way comes first, and every text is judged and shown as by the patterns."""
    texts = ["0", "-0", "7", "-7", "+7", "007", "999999999999999", "-99999999999999", "1000000000000000", "1.0", "1e3", "5%", "", "x", " 7", "٥", None]
    days = ["2010-10-18", "2010-02-30", "2010-2-3", "0001-01-01", "0000-01-01", "-0001-01-01", "12010-10-18", "2010-10-18Z", "2010-10-18T00", "epoch", "2010-10-1 ", "", None]
    for base, some, by_pattern in (("integer", texts, numbers.check), ("long", texts, numbers.check), ("positiveInteger", texts, numbers.check), ("date", days, dates.check)):
        df = spark.createDataFrame([(t,) for t in some], "t string")
        ok, lex = values.check(F.col("t"), Datatype(base=base))
        good, canonical = by_pattern(F.col("t"), base)[:2]
        for r in df.select("t", ok.alias("ok"), lex.alias("lex"), good.alias("good"), F.when(good, canonical).otherwise(F.col("t")).alias("canonical")).collect():
            assert (r.ok, r.lex) == (r.good, r.canonical), (base, r)
    for base in ("integer", "date"):
        plan = spark.range(1).select(F.uuid().alias("t")).select(values.check(F.col("t"), Datatype(base=base))[0].alias("ok"))._jdf.queryExecution().analyzed().toString()
        assert "CASE WHEN ((length(" in plan

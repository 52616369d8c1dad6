"""Column functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import names as N
from docloom.functions import pairs as P
from docloom.functions import text as T
from docloom.operators import crosswalk as C


def value(spark, c, **columns):
    df = spark.createDataFrame([tuple(columns.values()) or (0,)], list(columns) or ["x"])
    return df.select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "said", "expected"),
    [
        (T.normalize, "A|B | C-D", "ab c d"),
        (T.normalize_rule, "A|B | C-D", "a b c d"),
        (T.normalize_no_lower, "A|B | C-D", "AB C D"),
        (T.normalize, "x\ty | z", "x\ty z"),
        (T.clean_cell, "Foo ....", "Foo "),
        (T.is_money, "-1,000", True),
        (T.is_money, "1.5", False),
        (T.is_money, ",", True),
        (T.indentation, "   x ", 3),
        (T.ends_with_colon, " Total: .. ", False),
        (T.ends_with_colon, "Total:..", True),
        (T.num_caps, "aBÉc", 2),
        (T.strip_html, "a\n<script>x</script>b<STYLE>y</STYLE>", "ab"),
        (C.bill_folder, "H. Con. Res. 5", "hconres5"),
        (C.bill_folder, "H.R. 12", "hr12"),
        (C.bill_folder, "S. Res. 3", "sres3"),
        (C.bill_folder, "S. 9", "s9"),
    ],
)
def test_functions(spark, f, said, expected):
    assert value(spark, f(F.col("s")), s=said) == expected


def test_shingles_and_similarity(spark):
    s = lambda x: value(spark, T.shinglize(F.col("s")), s=x)
    assert sorted(s("a b c")) == ["a_b", "b_c"]
    assert s("a") == [] and s("") == []
    j = lambda a, b: value(spark, T.jaccard(F.col("a"), F.col("b")), a=a, b=b)
    assert j(["a_b", "b_c"], ["b_c", "c_d"]) == pytest.approx(1 / 3)
    assert value(spark, T.jaccard(T.shinglize(F.col("a")), T.shinglize(F.col("a"))), a="x") == 0
    assert j(["x"], ["x"]) == 1


def test_names(spark):
    known = F.array(F.lit("Smith"), F.lit("Jones"))
    assert not value(spark, N.has_sponsor(F.col("s"), known), s="Smith, Jones")
    assert value(spark, N.has_sponsor(F.col("s"), known), s="x y z | Smith;Jones")
    full, short = F.array(F.lit("Ohio"), F.lit("New York")), F.array(F.lit("OH"), F.lit("NY"))
    state = lambda s: value(spark, N.has_state(T.tokens(F.col("s")), full, short), s=s)
    assert not state("New York") and state("Ohio") and state("OHIO") and state("in OH")
    assert value(spark, N.surname(F.col("s")), s="SMITH, John") == "Smith"
    assert value(spark, N.surname(F.col("s")), s="O'NEIL, X") is None


def test_citations(spark):
    got = lambda f, s: value(spark, f(F.col("s")), s=s)
    assert [tuple(x)[:4] for x in got(C.all_citations_2005, "P.L. 108-449&&S. Rept. 109-7")] == [(108, "bill", "house", "hr2655"), (108, "report", "house", "260"), (109, "report", "senate", "7")]
    assert [tuple(x)[3] for x in got(C.all_citations_2005, "H.R. 4818")] == ["hr4818", "599", "792", "346"]
    assert got(C.all_citations_2005, "nothing") == []
    assert tuple(got(C.citation_2008, "P.L. 110-116"))[3] == "hr3222"
    assert tuple(got(C.citation_2009, "Div. A, Defense 1"))[3] == "hr2638"
    assert tuple(got(C.citation_2009, "H. Report 110-99"))[:4] == (110, "report", "house", "99")
    assert tuple(got(C.citation_2010, "P.L. 111-88"))[3] == "hr2996"
    assert got(C.citation_2010, "none") is None
    assert value(spark, C.division_version(F.col("s")), s="Div. C Energy") == "CPRT-111JPRT47494-DivisionC"
    assert value(spark, C.division_version(F.col("s")), s="x") == "eh"


def test_pairs(spark):
    d = value(spark, P.sphere_distance(F.lit(10.0), F.lit(20.0), F.lit(10.0), F.lit(20.0)))
    assert d == pytest.approx(0, abs=1e-6)
    assert value(spark, P.cast_or(F.col("s"), "double", 2.0), s="x") == 2.0
    assert value(spark, P.cast_or(F.col("s"), "int", 0), s="") == 0

"""Frequent lines: an absolute limit, and one of near copies that stays."""

from weightloom.llm import quality

SCHEMA = "doc_id long, text string, source string"


def body(i):
    return " ".join(f"w{i}x{k}" for k in range(30))


def kept(df):
    return {r.doc_id: r.text for r in quality.clean(df).collect()}


def test_limit_does_not_grow_with_the_host(spark):
    rows = [(i, ("shared footer\n" if i < 8 else "") + body(i), "large" if i < 200 else "small") for i in range(200)]
    rows += [(i, "small footer\n" + body(i), "small") for i in range(200, 207)]
    got = kept(spark.createDataFrame(rows, SCHEMA))
    assert sorted(got) == list(range(207)) and not any("footer" in t for t in got.values())


def test_one_of_near_copies_stays(spark):
    lines = "\n".join(body(k) for k in range(5))
    rows = [(i, body(100 + i), "h") for i in range(40)]
    rows += [(50 + i, f"{lines}\nversion {i}", "h") for i in range(60)] + [(200, f"{lines}\nversion 0", "h")]
    got = kept(spark.createDataFrame(rows, SCHEMA))
    assert sorted(got) == [*range(40), 50, 200]
    assert got[50] == f"{lines}\nversion 0"

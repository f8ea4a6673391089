from pyspark.sql import functions as F

from lattica.functions import parse


def triples(spark, response, function=parse.response_triples):
    df = spark.createDataFrame([(response,)], "r string").select(F.inline(function(F.col("r"))))
    return [tuple(r) for r in df.select("h", "r", "t").collect()]


def test_tiers(spark):
    plain = '{"h": "A", "r": "b", "t": "C"}\n{"h": "D", "r": "e", "t": "F"}'
    assert triples(spark, plain) == [("A", "b", "C"), ("D", "e", "F")]
    assert triples(spark, "```json\n" + plain + "\n```") == [("A", "b", "C"), ("D", "e", "F")]
    assert triples(spark, "{'h': 'A', 'r': 'b', 't': 'C'}") == [("A", "b", "C")]
    assert triples(spark, '{"subject": "A", "predicate": "b", "object": "C"}') == [("A", "b", "C")]
    assert triples(spark, '{"head": "A", "relation": "b", "tail": "C"}') == []
    mixed = '{"h": "A", "r": "b", "t": "C"}\n{"h": "Alzheimer\'s disease", "r": "b", "t": "C"}'
    assert triples(spark, mixed) == [("A", "b", "C")]
    assert triples(spark, "{“h”: “A”, “r”: “b”, “t”: “C”}") == []
    assert triples(spark, 'x {"r": "b", "h": "A", "t": "C"} y') == [("A", "b", "C")]
    assert triples(spark, "") == [] and triples(spark, None) == []
    assert triples(spark, '{"h": " ", "r": "b", "t": "C"}') == []


def test_strict(spark):
    assert triples(spark, '```\n{"h": "A", "r": "b", "t": "C"}\nnoise\n```', parse.strict_triples) == [("A", "b", "C")]


def test_needs_another_try(spark):
    cases = {"": True, "No triples found in this text, sorry about that, really none.": False, "ok": False, "x" * 60: True, '"h"' + "x" * 60: False}
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, r string").orderBy("i")
    assert [r[0] for r in df.select(parse.needs_another_try(F.col("r"))).collect()] == list(cases.values())


def test_entity_list(spark):
    cases = ['["alpha", "be", "gamma"]', 'x "alpha" and "gamma"', "- alpha\n- gamma", "alpha, gamma, b"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, r string").orderBy("i")
    assert [r[0] for r in df.select(parse.entity_list(F.col("r"))).collect()] == [["alpha", "gamma"]] * 4


def test_sections(spark, collect):
    df = spark.createDataFrame([(1, "intro\n## A\nx\n##\ny\n### B\nz"), (2, "plain"), (3, None), (4, "")], "id int, text string")
    assert collect(parse.sections(df, "id", "text")) == [
        (1, 1, 2, "A", "x"), (1, 2, 2, "", "y"), (1, 3, 3, "B", "z"), (2, 1, 1, "Full Text", "plain"), (4, 1, 1, "Full Text", ""),
    ]
    assert collect(parse.sections(df, "id", "text", fallback=False)) == [(1, 1, 2, "A", "x"), (1, 2, 2, "", "y"), (1, 3, 3, "B", "z")]


def test_log_events(spark, collect):
    lines = [
        "[3/9] ok 12 triples found for doc ab12 and more in 4.5s", "Extracted 7 triples from m1 in 2.5s", "Failed to extract triples from m2 after 60.0s",
        "Regeneration attempt 1/3 for m1", "Read timed out", "nothing", "HTTPError: 500",
    ]
    df = parse.log_events(spark.createDataFrame([(x,) for x in lines], "line string")).select("kind", "done", "triples", "subject", "seconds")
    assert collect(df) == sorted(
        [
            ("completed", 3, 12, "ab12", 4.5), ("extracted", None, 7, "m1", 2.5), ("failed", None, None, "m2", 60.0), ("fault", None, None, None, None),
            ("retry", 1, None, "m1", None), ("timeout", None, None, None, None),
        ],
        key=repr,
    )


def test_answers(spark):
    row = spark.createDataFrame([('{"message": {"content": "hi"}}', "Answer: yes\n\nSources: x")], "j string, a string")
    assert tuple(row.select(parse.answer_content(F.col("j")), parse.answer_slice(F.col("a"))).first()) == ("hi", "yes")

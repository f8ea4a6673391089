from lattica.llm.exact_copies import collapsed, copies

NAMES = {"name": True}


def found(spark, collect, values, fields=NAMES):
    df = spark.createDataFrame([(f"e{i:03d}", v) for i, v in enumerate(values)], "id string, name string").selectExpr("*", "'x' as k", "1 as digest", "2 as inv", "3 as v0")
    return collect(copies(df, "id", fields))


def test_formatting_is_no_content(spark, collect):
    same = ["flexible H2O loop at 1.5 nm", "Flexible  h2o\tLoop at 1.5 NM", "flexibleH2OLoopAt1.5Nm", "loop at 1.5 nm, flexible H2O", '"flexible_H2O_loop_at_1.5_nm"', "flexible​ H2O loop at 1.5 nm."]
    assert found(spark, collect, same) == [("e000", f"e{i:03d}") for i in range(1, len(same))]


def test_content_is_kept(spark, collect):
    assert found(spark, collect, ["at 2.8 V", "at 28 V", "naïve", "naive", "Na+", "Na", "b a", "a b", "2/3", "23", "x, y, z", "z x y"]) == []


def test_case_of_all_letters(spark, collect):
    assert found(spark, collect, ["μ-law ß", "Μ-LAW SS"]) == [("e000", "e001")]


def test_swap_only_in_names(spark, collect):
    assert found(spark, collect, ["b, a", "a b"], {"name": False}) == []
    assert found(spark, collect, ["b, a", "a b"]) == [("e000", "e001")]
    assert found(spark, collect, ["a b,", ", a b", "a b"]) == [("e000", "e001"), ("e000", "e002")]


def test_nulls_empties_and_repeats(spark, collect):
    assert found(spark, collect, [None, None, "", "--", "x"]) == [("e000", "e001"), ("e002", "e003")]
    df = spark.createDataFrame([("a", "x"), ("a", "X"), ("b", "x!")], "id string, name string")
    assert collect(copies(df, "id", NAMES)) == [("a", "b")]
    assert collect(copies(df.limit(0), "id", NAMES)) == []
    assert collect(collapsed(df.where("id <> 'a'").union(df.where("name = 'X'")), "id", NAMES)) == [("a", "X", 2)]


def test_hot_group_and_long_text(spark, collect):
    values = ["Hot Name"] * 400 + [f"name {i}" for i in range(800)] + ["long " * 50_000, "LONG " * 50_000]
    got = found(spark, collect, values)
    assert len(got) == 400 and {g[0] for g in got} == {"e000", "e1200"}

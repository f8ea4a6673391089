from pyspark.sql import functions as F

from lattica.functions.text import match_key
from lattica.operators import chunks, corpus, dedupe, evaluation, lookups, retrieval, triples, vector
from lattica.plans import graph_queries, text_queries


def test_processed_first(spark, collect):
    df = spark.createDataFrame(
        [(0, "f1", False), (1, "f1", True), (2, "f1", True), (3, "f2", False), (4, "f2", False), (5, None, False), (6, None, True)],
        "i int, f string, p boolean",
    )
    assert [r[0] for r in collect(dedupe.processed_first(df, "f", "p", ["i"]))] == [1, 4, 5, 6]


def test_keep_first_ties_nulls_and_clashing_names(spark, collect):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (None, "c", 1), (None, "d", 1), (2, None, None)], "__key0 int, n string, o int")
    assert collect(dedupe.keep_first(df, ["__key0"], ["o", "n"])) == [(1, "b", 1), (2, None, None), (None, "c", 1)]
    assert collect(dedupe.keep_first(df.limit(0), ["n"], ["o"])) == []


def test_duplicates(spark, collect):
    df = spark.createDataFrame([("Café", "uses", "X"), ("cafe", "uses", "X"), ("Café", "uses", "X"), ("y", "r", "z")], "h string, r string, t string")
    assert collect(dedupe.duplicates(df, ["h", "r", "t"], match_key)) == [("Café", "uses", "X", 3), ("cafe", "uses", "X", 3)]


def test_dense_ids(spark, collect):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("k")).repartition(5)
    got = collect(dedupe.dense_ids(df, ["k"], "n"))
    assert got == [(k, n) for n, k in enumerate(sorted(r[0] for r in got))] or sorted(got, key=lambda x: x[1]) == [(k, n) for n, k in enumerate(sorted(r[0] for r in got))]
    first = dedupe.ordinals(spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "k string, o int"), "k", "o")
    assert collect(first) == [("a", 1), ("b", 0)]


def test_rekeyed(spark, collect):
    entities = spark.createDataFrame([("e0", "Café"), ("e1", "x")], "entity_id string, entity_name string")
    facts = spark.createDataFrame([("p", "cafe", "nobody")], "predication_id string, subject_entity_name string, object_entity_name string")
    assert collect(triples.rekeyed(facts, entities).select("subject_id", "object_id")) == [("e0", None)]
    assert collect(triples.rekeyed(facts, entities, raw=True).select("subject_id")) == [(None,)]


def test_validity(spark, collect):
    df = spark.createDataFrame([("Alice", "knows", "Bob"), ("", "a", "b"), ("nan", "a", "b"), ("x", None, "y")], "h string, r string, t string")
    assert collect(df.where(triples.is_valid(F.col("h"), F.col("r"), F.col("t"))).select("h")) == [("Alice",)]


def test_ontology(spark, collect):
    df = spark.createDataFrame([("a b", "is-linked", "c"), ("a b", "is_linked", "c"), ("a", "name", "b")], "h string, r string, t string")
    assert collect(triples.ontology_assertions(df)) == [("a_b", "is_linked", "c")]
    assert triples.ontology_lines(df, "u").count() == 4
    assert dict(collect(triples.integrity(df, df.select(F.col("h").alias("entity_name"))))) == {"blank_entity": 0, "unknown_end": 3, "reserved_property": 1, "self_loop": 0}


def test_lookups(spark, collect):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([("x", 9), ("y", 3), (None, 4)], "k string, v int")
    assert collect(lookups.precedence_union(a, b, ["k"])) == sorted([("x", 1), (None, 2), ("y", 3), (None, 4)], key=repr)
    assert collect(lookups.updated(a, b, ["k"], ["v"])) == sorted([("x", 9), (None, 2)], key=repr)
    assert collect(lookups.updated(a, b, ["k"], ["v"], overwrite=False)) == sorted([("x", 1), (None, 2)], key=repr)
    edges = spark.createDataFrame([("n", 1, 5), ("n", 2, 5), ("m", 3, 5), ("n", 1, 6), ("n", 1, 5)], "field string, source long, target long")
    assert collect(lookups.common_citers(edges, "n", "m")) == [(5, 2, "1;2", 1, "3")]


def test_retrieval(spark, collect):
    names = spark.createDataFrame([("Synaptic Plasticity",), ("memory",), (None,)], "entity_name string")
    terms = spark.createDataFrame([("plastic",), ("",), (None,)], "term string")
    assert collect(retrieval.substring_entries(names, terms)) == [("plastic", "Synaptic Plasticity")]
    facts = spark.createDataFrame([("a", "r", "b", "d1"), ("b", "r", "c", "d1"), ("c", "r", "d", "d2"), ("a", "q", "e", None)], "h string, r string, t string, document_id string")
    top, docs = retrieval.ranked_triples(facts, spark.createDataFrame([("a",)], "entity_name string"))
    assert [(r.h, r.t) for r in top.collect()] == [("a", "b"), ("b", "c"), ("a", "e")] and collect(docs) == [("", 1), ("d1", 2)]
    texts = spark.createDataFrame([("d1", "T", "x y"), ("d9", "no", "no")], "document_id string, title string, text string")
    prompt = retrieval.context(top, texts, F.lit("why?"), "{context}\n{query}", ["h", "r", "t"]).first()[0]
    assert prompt == "a | q | e\na | r | b\nb | r | c\n\nT\nx y\nwhy?"


def test_vectors(spark, collect):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None)], "i long, v array<double>")
    near = vector.nearest(df, df.where("i = 0"), 2, "i", "v")
    assert collect(near) == [(0, 0, 1.0, 1), (0, 2, 1.0, 2)]
    assert [r[1] for r in collect(vector.nearest(df, df.where("i = 1"), 2, "i", "v", "l2"))] == [0, 1]
    assert collect(df.select(vector.norm(vector.unit(F.col("v"))).alias("n")).where("n is not null").distinct()) == [(1.0,)]


def test_chunks(spark, collect):
    code = "import x\n\ndef f():\n    return 1\n\nclass C:\n    def m(self):\n        pass\n"
    df = spark.createDataFrame([(1, code), (2, "not python ("), (3, None), (4, "")], "i long, t string")
    assert collect(chunks.python_definitions(df, "i", "t")) == [(1, "C", 6, 8), (1, "C.m", 7, 8), (1, "f", 3, 4)]
    assert collect(chunks.python_chunks(df, "i", "t").select("name")) == [("<module>",), ("C",), ("f",)]
    assert [r[1:3] for r in collect(chunks.line_windows(df.where("i = 1"), "i", "t", 4))] == [(0, 1), (1, 5), (2, 9)]


def test_chunks_of_whole_texts(spark, collect):
    """Texts that don't parse, without definitions, or empty ones are one chunk."""
    df = spark.createDataFrame([(1, "x = 1\ndef f():\n    return x\n"), (2, "not python (\n"), (3, None), (4, ""), (5, "x = 1\r\n")], "i long, t string")
    want = [(1, "<module>", "x = 1"), (1, "f", "def f():\n    return x"), (2, "<module>", "not python (\n"), (4, "<module>", ""), (5, "<module>", "x = 1\r\n")]
    assert collect(chunks.python_chunks(df, "i", "t", whole=True)) == sorted(want, key=repr)


def test_code_query_keeps_every_text(spark, collect, tmp_path):
    spark.createDataFrame([(1, "code_chunk", "not python ("), (2, "code_chunk", "x = 1"), (3, "note", "x")], "doc_id long, doc_kind string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r[0] for r in collect(text_queries.t12_python_chunks(spark, str(tmp_path)))] == [1, 2]


def test_question_enters_at_any_node(spark, collect, tmp_path):
    """Entry points are names of the graph, also those that the vocabulary does not hold."""
    columns = "subject_entity_name string, predicate string, object_entity_name string, document_id string, model_name string, predication_id string, prompt_filename string, extracted_at timestamp_ntz"
    facts = [("Rat WORKING-memory trace", "uses", "x", "d", "m", "p1", None, None), ("x", "causes", "y", "d", "m", "p2", None, None), ("other", "is", "z", "d", "m", "p3", None, None)]
    spark.createDataFrame(facts, columns).write.parquet(str(tmp_path / "predication.parquet"))
    spark.createDataFrame([("v", "working memory")], "entity_id string, canonical_name string").write.parquet(str(tmp_path / "vocab_entity.parquet"))
    assert collect(graph_queries.c10_ask(spark, str(tmp_path)).select("predication_id", "depth")) == [("p1", 0), ("p2", 1)]


def test_strict_triples_of_all_forms(spark, collect, tmp_path):
    """Plain, fenced and surrounded JSON lines give triples; single quotes and other keys don't."""
    columns = "predication_id string, subject_entity_name string, predicate string, object_entity_name string"
    spark.createDataFrame([(f"pred_{i}", "a", "b", "c") for i in range(5)], columns).write.parquet(str(tmp_path / "predication.parquet"))
    assert [r[0] for r in collect(text_queries.t05_strict_triples(spark, str(tmp_path)))] == ["pred_0", "pred_1", "pred_4"]


def test_corpus(spark, collect):
    df = spark.createDataFrame([(1, "T", [(1, "H", "b"), (2, None, "c")]), (2, None, None)], "i int, title string, s array<struct<level:int,heading:string,body:string>>")
    assert collect(df.select(corpus.paper_text(F.col("title"), F.col("s")), corpus.section_text(F.col("s")))) == [("", ""), ("T\n\nH\n\nb\n\nc", "b c")]


def test_evaluation(spark, collect):
    df = spark.createDataFrame([("g", "naive", 1.0), ("g", "rag", 3.0), ("g", "rag", float("nan"))], "g string, v string, m double")
    assert collect(evaluation.variant_means(df, "v", ["m"])) == [("naive", 1.0), ("rag", 3.0)]
    assert collect(evaluation.baseline_delta(df.where("not isnan(m)"), "g", "v", "m", "naive")) == [("g", "rag", 2.0)]
    log = spark.createDataFrame([(i, 100, i) for i in range(90)] + [(200, 50, 1)], "o int, total int, done int")
    assert evaluation.recent_run(log.where("o < 200"), ["o"], "total", "done").count() == 21

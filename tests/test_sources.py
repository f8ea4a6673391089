import json

from lattica.sources import files


def test_piped_and_triples(spark, collect, tmp_path):
    df = spark.createDataFrame([("e1", 'a "b"|c', None)], "entity_id string, entity_name string, entity_type string")
    files.write_piped(df, str(tmp_path / "doc_entities.txt"))
    back = files.read_piped(spark, str(tmp_path / "doc_entities.txt"), "entity_id string, entity_name string, entity_type string")
    assert collect(back.drop("file_stem")) == [("e1", 'a "b"|c', None)]
    (tmp_path / "d7.jsonl").write_text('{"h": "a", "r": "b", "t": "c", "_model": "m"}\n\n{broken\n')
    assert collect(files.read_triples(spark, str(tmp_path / "d7.jsonl")).select("h", "_model", "document_id")) == [("a", "m", "d7")]


def test_papers_lines_documents(spark, collect, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"title": "T", "sections": [{"section_title": "H", "section_text": "x"}, {"content": "y"}, {"heading": "Z", "body": "z", "level": 2}]}]))
    got = files.read_papers(spark, str(tmp_path / "p.json")).first()
    assert [(s.heading, s.body) for s in got.sections] == [("H", "x"), (None, "y"), ("Z", "z")]
    (tmp_path / "l.txt").write_text(" a \n\nb\n")
    assert collect(files.read_lines(spark, str(tmp_path / "l.txt"))) == [("a",), ("b",)]
    assert collect(files.read_documents(spark, str(tmp_path / "l.txt"))) == [("l", " a \n\nb\n")]
    (tmp_path / "run.log").write_text("x\ny")
    (tmp_path / "run.log.1").write_text("w")
    assert collect(files.read_logs(spark, str(tmp_path / "run.log*"))) == [(0, 0, "x"), (0, 1, "y"), (1, 0, "w")]


def test_graphml(spark, collect, tmp_path):
    nodes = spark.createDataFrame([("a&b",), ("c",)], "node string")
    edges = spark.createDataFrame([("a&b", "c", "r<")], "src string, dst string, relation string")
    text = "\n".join(r.line for r in files.graphml_lines(nodes, edges).orderBy("part", "line").collect())
    (tmp_path / "g.graphml").write_text(text)
    assert collect(files.read_graphml_edges(spark, str(tmp_path / "g.graphml"))) == [("a&b", "c", "r<")]

from lattica.llm.scanned import Findings, repaired_table

CLEAN = "\n\n".join(
    "The spiking network regulates every neuron at matched energy and the circuit controls a state-dependent synapse in the cortex." for _ in range(40)
)
SCANNED = "\n".join(
    [
        "The spiking network regulates every neu-", "ron at matched energy and the circuit con­", "trols a state-", "dependent synapse in the cortex.", "",
        "Brain Letters 12 (1999)", "Page 7", "", "The sp!king network, Rcgulates, every neuron at", "", "Brain Letters 12 (1999)", "Page 8", "",
        "matched energy and the circuit controls", "Table 2", "17", "0.5", "(3)", "", "The netvvork regulates the cor-", "tcx.",
    ]
)


def docs(spark):
    rows = [("a", "On the spiking network", CLEAN, None), ("b", "On the spiking network", SCANNED, ""), ("c", None, None, None), ("d", "t", "", "one line"), ("e", "t", "x" * 200_000, None)]
    return spark.createDataFrame(rows, "document_id string, title string, body string, abstract string").selectExpr("*", "'z' as key", "1 as line_no", "'q' as kind")


def test_findings(spark, collect):
    got = {}
    for key, field, line, kind in collect(Findings(docs(spark)).cases()):
        assert (key, field) == ("b", "body")
        got.setdefault(kind, []).append(line)
    assert {k: sorted(v) for k, v in got.items()} == {"header": [6, 11], "page": [7, 12], "hyphen": [1, 2, 20], "misread": [9, 20, 21]}


def test_repair(spark):
    got = {(r.document_id, r.field_name): r.text for r in repaired_table(docs(spark)).collect()}
    assert got["a", "body"] == CLEAN and got["c", "body"] is None and got["d", "body"] == "" and got["d", "abstract"] == "one line" and got["e", "body"] == "x" * 200_000
    text = got["b", "body"]
    assert "neuron at matched energy and the circuit controls a state-dependent synapse" in text
    assert "The spiking network, Regulates, every neuron at matched energy and the circuit controls" in text
    assert "Letters" not in text and "Page" not in text and "network regulates the cortex" in text


def test_empty_table(spark, collect):
    empty = docs(spark).limit(0)
    assert collect(Findings(empty).cases()) == [] and collect(repaired_table(empty)) == []

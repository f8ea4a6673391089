import pytest
from pyspark.sql import functions as F

from lattica.functions import text


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


CASES = {
    text.match_key: [
        ("Hello World!", "hello world"), ("Café", "cafe"), ("  Test   ", "test"), ("", ""), ("Spike-Timing", "spiketiming"),
        ("α-synuclein", "synuclein"), ("β", ""), ("a_b", "a_b"), ("½ Watt", "12 watt"), ("ﬁring", "firing"), (None, None),
    ],
    text.relation_canonical: [
        ("uses for", "use_for"), ("Is-A", "be_a"), ("enables", "enabl"), ("enabled", "enabl"), ("causes", "caus"),
        ("realizes_biology", "realiz_biology"), ("validated by neuroscience", "validat_by_neuroscience"), ("based on", "based_on"),
        ("trained_on", "train_on"), ("gives", "give"), ("meetings", "meeting"), ("__has--part__", "have_part"), ("was", "be"), (None, None), ("", ""),
    ],
    text.clean_up: [
        ('"quantum computing"', "quantum computing"), (":node_123 artificial intelligence", "node_123 artificial intelligence"), ("x:node_y", "xy"),
        ("A neuron", "neuron"), ("all synapses", "synapses"), ("##a gate!!", "gate"), ('("quoted")', '"quoted"'), ("a", "a"), ("--", ""), (" a cell", " a cell"),
    ],
    text.title_key: [("<i>On</i>  the Brain: A-B", "on the brain ab"), (None, None)],
    text.folder_name: [('a<b>:c"', "abc"), (" . ", "untitled"), (None, "untitled"), ("x" * 200, "x" * 100)],
    text.seconds_of: [("61.2s", 61.2), ("none", None)],
    text.host_of: [("http://a.b:80/c", "a.b"), ("nothing", "")],
    text.stem_of: [("/x/y.tar.gz", "y.tar"), ("12.pdf", "12")],
    text.scholar_id: [("10.48550/arXiv.1234.5", "ARXIV:1234.5"), ("10.1/x", "DOI:10.1/x")],
    text.as_int: [("2021.0", 2021), ("x", 0), (None, 0)],
    text.without_jats: [("<jats:p>a</jats:p>", "a</jats:p>")],
    text.html_to_text: [("<h1> T </h1><script>x</script><p>a<br>b</p><li>c</li>", "# T\na\nb\n\n- c")],
}


@pytest.mark.parametrize("function", CASES, ids=lambda f: f.__name__)
def test_values(spark, function):
    values, wanted = zip(*CASES[function])
    assert apply(spark, function, values) == list(wanted)


def test_entity_canonical(spark):
    cases = {
        "Spikes Between Layers Of Neuron": "spike between layer of neuron", "Graph Neural Networks": "graph neural network", "CNN": "CNN", "CNNS": "CNNS",
        "CMOS": "cmos", "STDPs": "stdp", "Studies": "study", "Series": "sery", "Boxes": "box", "Processes": "process", "Buses": "buse",
        "Synapses": "synapse", "Analysis": "analysis", "Stimulus": "stimulus", "IBM TrueNorth": "IBM truenorth", "3D-NAND Devices": "3d-nand device",
    }
    assert apply(spark, lambda c: text.entity_canonical(c, ("cmos", "mos")), list(cases)) == list(cases.values())


def test_dates_and_durations(spark):
    df = spark.createDataFrame([([2020, 3, 7],), ([2020],), ([],), (None,)], "p array<int>")
    assert [r[0] for r in df.select(text.date_parts(F.col("p"))).collect()] == ["2020-03-07", "2020", None, None]
    df = spark.createDataFrame([(3725.9,), (61.0,), (5.0,), (None,)], "s double")
    assert [r[0] for r in df.select(text.duration_text(F.col("s"))).collect()] == ["1h2m5s", "1m1s", "5s", None]

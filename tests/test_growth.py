"""Growing tables, recorded responses, uncapped loops, folding, rendering and paths on small fixtures."""

import math
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import parse, text
from lattica.operators import chunks, community, graph, merging, vector
from lattica.operators.steiner import steiner
from lattica.session import drop_written, shared_folder, written
from lattica.sources import files, records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_upsert_and_last(spark, collect):
    df = lambda rows: spark.createDataFrame(rows, "k string, n int, x string")
    old, new = df([("a", 1, "old"), (None, 1, "none")]), df([("a", 2, "new"), ("b", 3, "late"), ("b", 2, "first"), (None, 9, "y")])
    got = merging.upserted(old, new, "k", ["n"], ["k", "x"])
    assert collect(got) == sorted([("a", "old"), (None, "none"), ("b", "first"), (None, "y")], key=repr)
    assert collect(merging.last_of(new, "k", ["n"], ["k", "x"])) == [("a", "new"), ("b", "late")]
    assert collect(merging.upserted(old.limit(0), new.limit(0), "k", ["n"], ["k", "x"])) == []


def test_work_list_is_refused_beyond_its_bound(spark, collect):
    docs, settings = spark.createDataFrame([("d",), ("e",)], "doc string"), spark.createDataFrame([("m", "p"), ("n", "p")], "model string, prompt string")
    done = spark.createDataFrame([("d", "m", "p")], "doc string, model string, prompt string")
    assert collect(merging.work_list(docs, "doc", settings, done)) == [("d", "n", "p"), ("e", "m", "p"), ("e", "n", "p")]
    with pytest.raises(ValueError):
        merging.work_list(docs, "doc", settings, done, most=1)


def test_rich_graphs(spark, collect):
    good = '{"nodes": [{"id": "1", "name": "x"}, {"id": "1", "name": "y"}], "edges": [{"source": "1", "relation": "r", "target": "2"}]}'
    rows = spark.createDataFrame([("a", good), ("b", f"[{good}]"), ("c", good[:-4]), ("d", None), ("e", "{}"), ("f", "")], "k string, body string")
    graphs = rows.select("k", records.rich_graph(F.col("body")).alias("g"))
    assert collect(records.graph_triples(graphs, "k", "g")) == [("a", "y", "r", "2"), ("b", "y", "r", "2")]


def test_records(spark):
    body = '{"message": {"title": ["T"], "DOI": "10.1/X", "author": [{"given": "A", "family": "B"}, {"name": "Team"}], "created": {"date-parts": [[2020, 3]]}, "reference": [{"DOI": "10.1/Y"}, {}]}}'
    r = one(spark, records.registry_record(F.lit(body)))
    assert (r.title, r.doi, r.authors, r.date, r.cited) == ("T", "10.1/x", "A B; Team", "2020-03", ["10.1/y"])
    assert one(spark, records.linked_dois(F.lit('{"data": [{"citedPaper": {"externalIds": {"ArXiv": "1.2", "DOI": "10.1/z"}}}, {"citedPaper": {"externalIds": null}}]}'))) == ["10.48550/arxiv.1.2"]
    assert one(spark, records.doi_token(F.lit("omid:1 doi:10.1/A pmid:3"))) == "10.1/a" and one(spark, records.doi_token(F.lit("doix:1"))) is None


def test_components_of_a_long_chain(spark, collect):
    n = 3000
    chain = spark.range(n).selectExpr("id as src", "id + 1 as dst")
    assert collect(graph.components(chain).groupBy("component").count()) == [(0, n + 1)]


def test_communities_settle(spark):
    """Cliques in a ring are the communities of either objective; every label is one connected piece."""
    size, groups = 6, 5
    cliques = [(g * size + i, g * size + j) for g in range(groups) for i in range(size) for j in range(i)]
    ring = [(g * size, ((g + 1) % groups) * size + 1) for g in range(groups)]
    links = spark.createDataFrame(cliques + ring, "src long, dst long")
    for kind in ({"refine": False}, {}, {"gamma": 0.3}):
        found = community.communities(links, **kind).collect()
        label = {r.node: r.community for r in found}
        assert len(found) == size * groups and len(set(label.values())) == groups
        assert all(label[g * size] == label[g * size + i] for g in range(groups) for i in range(size))
    assert community.communities(links.limit(0)).collect() == []


def ring_of_cliques(spark, size, groups):
    cliques = [(g * size + i, g * size + j) for g in range(groups) for i in range(size) for j in range(i)]
    return spark.createDataFrame(cliques + [(g * size, ((g + 1) % groups) * size + 1) for g in range(groups)], "src long, dst long")


def test_communities_of_one_block_take_one_task(spark, monkeypatch):
    """A graph that fits a block is written once and settled in one step, however many moves it takes."""
    steps = []
    monkeypatch.setattr(community, "written", lambda df, name, **kw: (steps.append(name), written(df, name, **kw))[1])
    for kind in ({"refine": False}, {}, {"gamma": 0.3}):
        steps.clear()
        assert community.communities(ring_of_cliques(spark, 6, 5), **kind).select("community").distinct().count() == 5
        assert len(steps) <= 2


def test_communities_of_many_blocks(spark):
    """However few links a task holds, every clique is one community, named by its least node."""
    links = ring_of_cliques(spark, 5, 4)
    for kind in ({"refine": False}, {"gamma": 0.3}):
        found = community.communities(links, block=50, **kind).collect()
        assert sorted((r.node, r.community) for r in found) == [(n, n // 5 * 5) for n in range(20)]


def random_block(n, m, heaviest=1, seed=3):
    """A block of a random graph with a few popular nodes, and the links' total weight."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, n, m), (n * rng.random(m) ** 3).astype(np.int64)
    a, b = a[a != b], b[a != b]
    w = rng.integers(1, heaviest + 1, len(a)).astype(float)
    src, dst, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    weight = np.bincount(src, w, n)
    return community._Block(n, src, dst, w, weight, 1 / w.sum()), weight


def test_moves_go_by_batches_until_no_node_wants_to(monkeypatch):
    """Few nodes are asked alone, however many moves there are; in the end none wants to move."""
    asked, best = [], community._Block.best
    for heaviest in (1, 5):
        block, weight = random_block(4000, 24000, heaviest)
        comm, held = np.arange(block.n), weight.copy()
        with monkeypatch.context() as patch:
            patch.setattr(community._Block, "best", lambda self, *a: (asked.append(1), best(self, *a))[1])
            block.settle(np.arange(block.n), comm, held)
        assert len(asked) < block.n
        held = np.bincount(comm, weight, block.n).tolist()
        labels = comm.tolist()
        assert len(set(labels)) < block.n // 2 and all(block.best(i, labels, held) == labels[i] for i in range(block.n))


def test_batches_ask_what_single_nodes_ask(monkeypatch):
    """Over portions of any size a node's answer is that of looking at each of its neighbours' communities."""
    monkeypatch.setattr(community, "STEP", 70)
    for heaviest in (1, 9):
        block, weight = random_block(300, 1500, heaviest)
        comm = np.random.default_rng(heaviest).integers(0, 40, block.n)
        held = np.bincount(comm, weight, block.n)
        to, lacks = block.ask(np.arange(block.n), comm, held)
        gain = lambda i, c: sum(x for j, x in zip(block.dst[block.ends[i] : block.ends[i + 1]], block.w[block.ends[i] : block.ends[i + 1]]) if comm[j] == c) - block.share[i] * (held[c] - weight[i] * (c == comm[i]))  # noqa: E731,B023
        for i in range(block.n):
            single = block.best(i, comm.tolist(), held.tolist())
            assert (single == comm[i]) == (to[i] == comm[i]) == (lacks[i] >= 0) and abs(gain(i, single) - gain(i, to[i])) < 1e-6


def test_parts_stay_within_their_bounds():
    """Single nodes join parts inside their own community, until none that is alone wants to."""
    block, weight = random_block(3000, 15000)
    within = np.arange(block.n) % 7
    parts, held, members = np.arange(block.n), weight.copy(), np.ones(block.n, dtype=np.int64)
    block.gather(np.arange(block.n), parts, held, members, within)
    assert len(np.unique(parts)) < block.n and all(len(np.unique(within[parts == p])) == 1 for p in np.unique(parts))
    assert (members == np.bincount(parts, minlength=block.n)).all() and np.allclose(held, np.bincount(parts, weight, block.n))
    alone = np.flatnonzero(members[parts] == 1)
    assert (block.ask(alone, parts, held, within)[1] >= 0).all()


def test_steiner_reaches_far_terminals(spark, collect):
    chain = spark.range(90).selectExpr("id as src", "id + 1 as dst")
    tree = steiner(chain, spark.createDataFrame([(0,), (90,)], "node long"))
    assert tree.count() == 90


def test_folding_is_that_of_the_character_database(spark):
    for value in ("𝐀lpha ㎏ ǆ ½ … ﬃ é Å ① ™ ㏒ 回 😀", "ẹ́", "plain", "", "ᴀ ｆｕｌｌ"):
        assert one(spark, text.ascii_fold(F.lit(value))) == unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode()


def test_html(spark):
    page = "<html><style>p{}</style><h2 class='a'> Head </h2><p>One <code> x </code> two</p><ul><li>a<li>b</li></ul><PRE>\n code\n</PRE>1 < 2<br/>end<script>no</script></html>"
    assert one(spark, text.html_to_text(F.lit(page))) == "## Head\nOne `x` two\n\n- a- b\n\n```\ncode\n```\n1 < 2\nend"
    assert one(spark, text.html_to_text(F.lit(""))) == ""


def test_tiers_of_responses(spark):
    triples = lambda s: [tuple(t) for t in one(spark, parse.response_triples(F.lit(s)))]
    assert triples('{"h": "a", "r": "b", "t": "c"} {"t": "z", "h": "x", "r": "y"}') == [("a", "b", "c")]
    assert triples("{'subject': 'a', 'relation': 'b', 'object': 'c',}") == [("a", "b", "c")]
    assert triples('x\n{"r": "b", "h": "a {1}", "t": "c"}\ny') == [("a {1}", "b", "c")]
    assert triples('{ {"head": 1} {"r": "b",\n"h": "a", "t": "c"}') == [("a", "b", "c")]
    assert triples('{"h": "a", "r": " ", "t": "c"}') == [] and triples("") == [] and triples("no") == []


def test_nearest_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(3)) for _ in range(4)]) for i in range(400)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    good = rows[:400]
    for metric, score in (("ip", lambda a, b: math.sumprod(a, b)), ("l2", lambda a, b: -math.dist(a, b) ** 2)):
        got = {(r.query_id, r["rank"]): r.id for r in vector.nearest(df, df.where("id % 50 = 0"), 3, "id", "v", metric).collect()}
        for q, v in good[::50]:
            best = sorted(good, key=lambda x: (-round(score(v, x[1]), 9), x[0]))[:3]
            assert [got[q, k] for k in (1, 2, 3)] == [i for i, _ in best]
    assert vector.nearest(df, df.limit(0), 3, "id", "v").count() == 0
    with pytest.raises(ValueError):
        vector.nearest(df, df, 3, "id", "v", most_queries=10)


def test_python_api(spark, collect):
    source = 'class A(B):\n    """Says a.\n\n    More."""\n    def __init__(self, x=1): ...\n    def _no(self): ...\n    def run(self, *a): ...\ndef f(a, *, b: int = 2):\n    "Doc"\ndef _g(): ...\n'
    df = spark.createDataFrame([(1, source), (2, "not python ("), (3, None)], "k long, s string")
    got = [r[1:] for r in collect(chunks.python_api(df, "k", "s"))]
    assert got == [("class", "A", "B", "Says a."), ("function", "A.__init__", "self, x=1", ""), ("function", "A.run", "self, *a", ""), ("function", "f", "a, *, b: int=2", "Doc")]


def test_paths(spark, collect, tmp_path):
    (tmp_path / "deduped").mkdir()
    (tmp_path / "deduped" / "e.txt").write_text("entity_name|n\nx|1\n |2\n|3\nx|4\n")
    paths = [str(tmp_path / p / "*.txt") for p in ("refined", "deduped", "merged")]
    assert files.first_existing(spark, paths) == paths[1]
    assert collect(files.entity_names(spark, paths)) == [("x",)]
    assert files.read_merged(spark, [str(tmp_path / "refined"), str(tmp_path / "deduped")], "*.txt", "entity_name string, n int").count() == 4
    assert files.read_merged(spark, [str(tmp_path / "refined")], "*.txt", "entity_name string, n int").count() == 0
    assert collect(files.listing(spark, str(tmp_path), ".txt").select("name", "stem")) == [("e.txt", "e")]
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, paths[:1])


def test_writers(spark, collect, tmp_path):
    names = spark.createDataFrame([("b,c", 2), ('a"', 1)], "name string, n int")
    files.write_table(names, str(tmp_path / "t"), "name")
    assert collect(files.read_table(spark, str(tmp_path / "t"), "name string, n int")) == [('a"', 1), ("b,c", 2)]
    triples = spark.createDataFrame([("a", "r", "b", "d1")], "h string, r string, t string, document_id string")
    for _ in range(2):
        files.append_triples(triples, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    events = spark.createDataFrame([("2024-01-02 03:04:05", "x")], "at string, kind string")
    files.append_traces(events, str(tmp_path / "e"), "at")
    assert (tmp_path / "e" / "day=2024-01-02").is_dir()
    good, bad = files.parted_by_error(spark.createDataFrame([(1, None), (2, " "), (3, "oops")], "k int, error string"))
    assert collect(good.select("k")) == [(1,), (2,)] and collect(bad.select("k")) == [(3,)]
    assert files.result_record(triples, triples.select("document_id"), "q", ["h"]).first().result == '{"query":"q","triples":[{"h":"a","r":"r","t":"b","document_id":"d1"}],"documents":[{"document_id":"d1"}]}'


def test_written_frames_are_dropped(spark):
    a = written(spark.range(3), "a")
    b = written(a.selectExpr("id + 1 as id"), "b", replaces=a)
    assert b.count() == 3
    drop_written(b, spark.range(1))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(b._written_at).count()
    assert shared_folder(spark)

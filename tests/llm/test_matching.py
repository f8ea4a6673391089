import math

from lattica.llm.matching import _variants, _with_content, candidates, left_records, matches, propagate, right_records

PAPERS = "paper_id long, title string, doi string"
NODES = "id long, doi string, title string, authors string, pub_date string"
AUTHORS = "paper_id long, doi string, given string, family string, full_name string, issued string"
TITLE = "Event-driven annealing of distilled potentials in synchronous electrofields"


def run(spark, papers, nodes, authors=()):
    frames = [spark.createDataFrame(list(rows), schema).selectExpr("*", "'x' as key", "0 as l", "1 as odds") for rows, schema in ((papers, PAPERS), (authors, AUTHORS), (nodes, NODES))]
    return {(r.paper_id, r.node_id): r.confidence for r in matches(*frames).collect()}


def good(got):
    return sorted(p for p, c in got.items() if c >= 0.5)


AUTHOR = [(1, None, "Ann", "Sorbenko", None, "2020-05"), (1, None, "Bo", "Tellman", "Bo Tellman", "2020-05")]


def test_noise_and_other_kinds_of_work(spark):
    nodes = [
        (10, "10.1234/pub.1", "event-driven anealing of distilled potentials in synchronous electrofields", "A. Sorbenko; B. Tellman", "2020"),
        (11, "10.99009/prep.1", "arXiv preprint - " + TITLE.upper(), "Ann Sorbenko; Bo Tellman", "2019-11"),
        (12, "10.1234/pub.2", "Correction to: " + TITLE, "A. Sorbenko; B. Tellman", "2020"),
        (13, "10.1234/pub.3", TITLE + ": part 2", "A. Sorbenko; B. Tellman", "2021"),
        (14, "10.1234/pub.4", TITLE.replace(" of ", " beyond "), "A. Sorbenko; B. Tellman", "2021"),
        (15, None, "Something else about quiet reservoirs", "C. Other", "2020"),
        (16, None, None, None, None),
    ]
    got = run(spark, [(1, TITLE, "https://doi.example/10.1234%2FPUB.1"), (1, None, None), (2, None, None)], nodes, AUTHOR)
    assert good(got) == [(1, 10), (1, 11)]


def test_wrong_doi_loses_to_the_title(spark):
    nodes = [(10, "10.1234/pub.1", "A quite different title about reservoirs", "X. Nobody", "2003"), (11, None, TITLE, "A. Sorbenko; B. Tellman", "2020")]
    assert good(run(spark, [(1, TITLE, "10.1234/pub.1")], nodes, AUTHOR)) == [(1, 11)]


def test_one_partner_for_each_node(spark):
    nodes = [(10, "10.1234/pub.1", TITLE, "A. Sorbenko; B. Tellman", "2020")]
    got = run(spark, [(1, TITLE, "10.1234/pub.1"), (2, TITLE, None)], nodes, AUTHOR)
    assert good(got) == [(1, 10)] and sum(got.values()) <= 1.05


def test_empty_and_repeated(spark):
    assert run(spark, [], []) == {}
    assert good(run(spark, [(1, TITLE, None)] * 3, [(10, None, TITLE, "Sorbenko, A.", "2020")] * 2, AUTHOR)) == [(1, 10)]


def test_propagation_equals_enumeration_on_a_tree(spark):
    """On a graph without circles the marginals are exact: compared with all assignments."""
    import itertools

    edges = [(1, 10, 1.0), (1, 11, 0.5), (1, 12, 2.0), (2, 12, 1.5)]
    total, mass = 0.0, [0.0] * 4
    for pick in itertools.product((0, 1), repeat=4):
        left = sum(p for p, e in zip(pick, edges) if e[0] == 1)
        right = sum(p for p, e in zip(pick, edges) if e[1] == 12)
        if left <= 2 and right <= 1:
            weight = math.exp(sum(p * e[2] for p, e in zip(pick, edges)))
            total += weight
            mass = [m + p * weight for m, p in zip(mass, pick)]
    got = {(r.l, r.r): r.confidence for r in propagate(spark.createDataFrame(edges, "l long, r long, odds double")).collect()}
    for (l, r, _), m in zip(edges, mass):
        assert abs(got[l, r] - m / total) < 0.02


def test_hot_title(spark):
    """A title that a third of all records bear is told apart by authors."""
    n = 60
    papers = [(i, "Preface to the proceedings", None) for i in range(n)]
    authors = [(i, None, "A", f"Family{chr(97 + i % 26)}{chr(97 + i // 26)}bar", None, "2020") for i in range(n)]
    nodes = [(1000 + i, None, "Preface to the proceedings", f"A. Family{chr(97 + i % 26)}{chr(97 + i // 26)}bar", "2020") for i in range(n)]
    assert good(run(spark, papers, nodes, authors)) == [(i, 1000 + i) for i in range(n)]


def test_two_errors_in_a_short_title(spark):
    """No three content words in a row are left; with authors, and without."""
    title, seen = "How supervised optonodes shape the recurrent nanogate receptor", "How supervised optonodes shaep the recurrentt nanogate rceeptor"
    assert good(run(spark, [(1, title, None)], [(10, None, seen, "A. Sorbenko", "2020")], AUTHOR)) == [(1, 10)]
    seen = "Event-driven annealing of distiled potentials in synchronous electrofeilds"
    nodes = [(10, None, seen, None, "2020"), (11, None, "Event-driven anealing of distilled potentials in synchronus electrofields", "A. Sorbenkko", "2020")]
    assert good(run(spark, [(1, TITLE, None)], nodes, AUTHOR)) == [(1, 10), (1, 11)]
    one = AUTHOR[:1] + [(2, None, "Bo", "Tellman", None, "2020")]
    assert good(run(spark, [(1, "Quiet nanogates", None), (2, "Approach and evidence", None)], [(10, None, "Qiet nanogats", "A. Sorbenko", "2020"), (12, None, "Approach and evidence", "B. Tellman", "2020")], one)) == [(1, 10), (2, 12)]


def test_the_end_of_a_title_is_enough(spark):
    """The first five content words are lost or mistyped; the rest of the title is whole."""
    title = "Supervised optonodes reshape recurrent nanogate receptors during quiet reservoir annealing beyond distilled potentials"
    seen = "Suprevisde optonoeds rehsaep recurrnet nanogtae receptors during quiet reservoir annealing beyond distilled potentials"
    assert good(run(spark, [(1, title, None)], [(10, None, seen, "A. Sorbenko", "2020")], AUTHOR)) == [(1, 10)]
    lost = "Receptors during quiet reservoir annealing beyond distilled potentials"
    frame = lambda t: _variants(spark.createDataFrame([(1, [t], [], [], 2020)], "id long, titles array<string>, dois array<string>, families array<string>, year int"))
    left, right = _with_content(frame(title), frame(lost))
    assert candidates(left, right).count() == 1


def test_hot_title_with_misspelt_and_missing_authors(spark):
    """A key that many records bear is whole: a family name with an error, a record without authors, a cut DOI."""
    n, title = 40, "Winner take all circuits"
    name = lambda i: f"Family{chr(97 + i % 26)}{chr(97 + i // 26)}bar"
    papers = [(i, title, None) for i in range(n)] + [(n, title, None)]
    authors = [(i, None, "A", name(i) * 2, None, "2020") for i in range(n)] + [(n, None, "B", "Quorvexil", None, "1999")]
    nodes = [(1000 + i, None, title, "A. " + name(i) * 2, "2020") for i in range(n)] + [(2000, None, title, "B. Quorvxeil", "1999")]
    assert (n, 2000) in good(run(spark, papers, nodes, authors))
    nodes[-1] = (2000, None, title, None, "1999")
    assert (n, 2000) in good(run(spark, papers, nodes, authors))


def test_one_title_without_authors_makes_all_pairs_of_its_records(spark):
    """No key is capped: 21 papers and 21 nodes of one title without authors are 441 candidates."""
    title = "Winner take all circuits"
    papers = spark.createDataFrame([(i, title, None) for i in range(21)], PAPERS)
    nodes = spark.createDataFrame([(100 + i, None, title, None, None) for i in range(21)], NODES)
    left, right = _with_content(_variants(left_records(papers, spark.createDataFrame([], AUTHORS))), _variants(right_records(nodes)))
    assert candidates(left, right).count() == 441


def test_copies_share_their_confidence(spark):
    """Records that are alike in all evidence are one class: two papers and one node have half a chance each."""
    got = run(spark, [(1, TITLE, None), (2, TITLE, None)], [(10, None, TITLE, "A. Sorbenko", "2020")], AUTHOR[:1] + [(2, *AUTHOR[0][1:])])
    assert set(got) == {(1, 10), (2, 10)} and abs(got[1, 10] - got[2, 10]) < 1e-9 and got[1, 10] <= 0.5

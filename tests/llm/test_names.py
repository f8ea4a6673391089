from lattica.llm.names import _joined_by_orcid, _roots, entities, linked_pairs, nicknames

SCHEMA = "mention_id long, paper_id long, given string, family string, full_name string, orcid string, affiliation string"
A, B = "University of Aville", "Dept. of Physics, Bstadt Institute of Technology"


def people(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).selectExpr("*", "'x' as key", "'y' as place", "0 as n")


def clusters(spark, *rows):
    groups = {}
    for r in entities(people(spark, *rows)).collect():
        groups.setdefault(r.entity, []).append(r.mention_id)
    return sorted(sorted(g) for g in groups.values())


def test_spellings_of_one_person(spark):
    rows = [
        (1, "Katharina", "Stoberman", "Katharina Stoberman", None, A),
        (2, "Katharina", "Stoberman", None, None, "Univ. of Aville"),
        (3, "K.", "Stoberman", "Stoberman, K.", None, "UNIVERSITY OF AVILLE"),
        (4, "katharina", "stobermann", None, None, A),  # an error in the family name
        (5, "Kathrina", "Stoberman", None, None, A),  # an error in the given name
        (6, None, None, "Stoberman, Katharina", None, A),
        (7, None, "van der Stoberman", "Dr. Katharina van der Stoberman", None, A),
        (8, "Stoberman", "Katharina", "Stoberman Katharina", None, A),  # the wrong way round
        (8, "Other", "Person", "Other Person", None, A),
        (9, "Kofi", "Stoberman", "Kofi Stoberman", None, B),  # someone else elsewhere
        (9, "Katharina", "Bell", None, None, B), (10, "Katharina", "Hill", None, None, B),
    ]
    assert [0, 1, 2, 3, 4, 5, 6, 7] in clusters(spark, *rows)


def test_same_name_elsewhere_is_another(spark):
    rows = [(1, "Ann", "Lee-Park", None, None, A), (2, "Ann", "Lee-Park", None, None, A), (3, "Ann", "Lee-Park", None, None, B), (4, "Ann", "Lee", None, None, B)]
    assert clusters(spark, *rows) == [[0, 1], [2, 3]]


def test_context_of_the_paper_and_orcid(spark):
    rows = [
        (1, "Ann", "Sorbenko", None, None, A), (1, "Bo", "Tellman", None, None, A),
        (2, "Ann", "Sorbenko", None, None, B), (3, "A.", "Sorbenko", None, None, None), (3, "Bo", "Tellman", None, None, A),
        (4, "X.", "Unrelated", None, "0-1", None), (5, "Y", "Different", None, "0-1", None),
    ]
    got = clusters(spark, *rows)
    assert [0, 3] in got and [2] in got and [5, 6] in got


def test_organisations(spark):
    rows = [(i, None, None, n, None, A) for i, n in enumerate((
        "Berlavo Brain Working Group", "THE BERLAVO BRAIN WORKING GROUP", "Brain Working Group of Berlavo", "Berlavo Brain Working Group (BBWG)",
        "Brain Working Group, Berlavo", "Berlavo Brian Working Group", "Berlavo Connectome Consortium", "Berlavo Connectome Consortium", "Berlavo Connectome Cons.",
        "Talovo Connectome Consortium",
    ))]
    assert clusters(spark, *rows) == [[0, 1, 2, 3, 4, 5], [6, 7, 8], [9]]


def test_pairs_nulls_and_empties(spark, collect):
    rows = [(1, "Ann", "Lee", None, None, A), (None, "Ann", "Lee", None, None, A), (2, None, None, None, None, None), (3, " ", "", " ", "", " "), (4, "Ann", "Lee", None, None, A)]
    assert collect(linked_pairs(people(spark, *rows))) == [(0, 1), (0, 4), (1, 4)]
    assert collect(linked_pairs(people(spark, *rows).limit(0))) == []


def test_hot_name_and_long_names(spark, collect):
    rows = [(i, "Ann", "Hotname", None, None, A) for i in range(60)] + [(100 + i, f"G{chr(97 + i % 26)}x{chr(97 + i // 26)}", f"Fam{chr(97 + i % 26)}{chr(97 + i // 26)}zz", None, None, B) for i in range(120)]
    rows.append((900, "x" * 3000, "y" * 3000, None, None, A))
    assert sum(a < 60 and b < 60 for a, b in collect(linked_pairs(people(spark, *rows)))) == 60 * 59 // 2


def test_long_chains(spark):
    """Links of any length lead to their end; ORCIDs join chains of any length."""
    n = 40
    links = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(n)], "s string, to_s string")
    assert {r.to_s for r in _roots(links, ["s"]).collect()} == {f"w{n:02}"}
    rows = [(2 * i + k, f"e{i + k:02}", f"o{i:02}") for i in range(9) for k in (0, 1)] + [(100, "x", None), (101, "y", "alone")]
    got = {r.mention_id: r.entity for r in _joined_by_orcid(spark.createDataFrame(rows, "mention_id long, entity string, orcid string")).collect()}
    assert {got[i] for i in range(18)} == {"e00"} and got[100] == "x" and got[101] == "y"


def test_large_groups_count_for_known_nicknames(spark, collect):
    """One small group shows the pair; the other is a hot family with many first names."""
    forms = [("p", "small", g, 1) for g in ("robert", "bob")] + [("q", "hot", f"name{chr(97 + i)}x", 1) for i in range(20)] + [("q", "hot", g, 1) for g in ("robert", "bob")]
    assert collect(nicknames(spark.createDataFrame(forms, "place string, s string, g1 string, n long"))) == [("bob", "robert"), ("robert", "bob")]


def test_nicknames_of_large_groups_only(spark, collect):
    """No small group shows the pair, but it stands together far more often than chance would have it."""
    other = lambda k: [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i)}" * 3 for i in range(8)]
    forms = [(f"p{k}", "fam", g, 1) for k in range(40) for g in (*(("robert", "bob") if k < 8 else ()), *other(k))]
    assert collect(nicknames(spark.createDataFrame(forms, "place string, s string, g1 string, n long"))) == [("bob", "robert"), ("robert", "bob")]
    every = [(f"p{k}", "fam", f"n{chr(97 + i)}xq{chr(97 + i)}", 1) for k in range(3) for i in range(8)]  # all stand together always
    assert collect(nicknames(spark.createDataFrame(every, "place string, s string, g1 string, n long"))) == []


def test_name_without_place_goes_by_share(spark):
    """An entity that holds most of a name takes it; of two that hold it alike none does."""
    rows = [(1, "Ann", "Sorbenko", None, None, A)] * 5 + [(2, "Ann", "Sorbenko", None, None, B), (3, "Ann", "Sorbenko", None, None, None)]
    assert [0, 1, 2, 3, 4, 6] in clusters(spark, *rows)
    assert [2] in clusters(spark, rows[0], rows[5], rows[6])

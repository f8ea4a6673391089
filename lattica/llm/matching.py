"""Matching records of two sources that share no key, by belief propagation over candidate pairs.

Records whose whole evidence is alike are one class with a multiplicity; all work is done on classes, and a class pair is
spread to its records at the end. Candidates share a DOI, three of the first five content words of the
title, or two of the first three (of titles of one or two words: one or none) and an author's family name, or, where a side
names no author, those words alone. So any two lost or mistyped content words are survived; no key is capped. Words that stand side by side nearly always are one word; words of more than a twentieth of all titles
are no content.

The evidence of a pair is a pattern of five levels: title, authors, DOI, year, and the words by which the titles differ.
What the levels weigh is estimated from all candidate pairs by expectation maximisation over the counts of patterns with
three latent classes: the same work, a work of its own about it (reply, correction, part, follow-up), and strangers. Prior
counts stand in where data are few. Pairs with one DOI teach which words are mere labels; these against pairs of other DOIs
teach which words make another work of a title; titles and authors that are alike under two DOIs teach which registrants
hold second versions.

One-to-one factors then let the pairs compete: a right-hand record has at most one partner, a left-hand record at most two
(a preprint and the published version). Messages of these cardinality factors depend on sums over a record's pairs only, so
each round is two grouped sums joined back; rounds go on until no message moves by more than a tolerance. Pairs that are
the only ones of both their records get no message and stay out. Marginals are the confidences.

Skew: one hot title, key or group of copies is a class, or is joined as a plain join that Spark splits; sums are
pre-aggregated; every round is written, so lineage stays short and a lost executor costs one round.

Defined cases: records without title and DOI have no candidates; several rows of a record are variants, of which the
best supported counts; ties in the marginals stand as they are; null ids are left out; empty tables give no pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.names import PARTICLES, plain
from lattica.session import written

#: Words that say that a title names a work about another one, and the label of a work's earlier version.
KINDS = (
    "correction", "corrigendum", "erratum", "reply", "response", "comment", "comments", "retraction", "addendum", "replication", "followup",
    "part", "1", "2", "3", "4", "5",
)
VERSIONS = ("arxiv", "preprint")
_NUMERALS = ("i", "ii", "iii", "iv", "v")
#: Words in this share of all titles, and at least so many, are no content; words that stand together in this share of the
#: rarer one's titles, and in this share of all titles, are one.
COMMON_SHARE, COMMON_LEAST, TOGETHER, TOGETHER_SHARE = 0.05, 20, 0.8, 0.002
#: Share of the pairs learned from that a word must stand in to be judged, so that the lists of judged words are bounded.
WORD_SHARE, REGISTRANT_SHARE = 0.0005, 0.01
#: Prior shares of the levels (see :func:`_levels`) in the three classes, and how many pairs they count for.
PRIOR = {
    "title": ((0.01, 0.45, 0.25, 0.12, 0.08, 0.05, 0.02, 0.02), (0.01, 0.15, 0.1, 0.4, 0.2, 0.08, 0.04, 0.02), (0.01, 0.004, 0.004, 0.01, 0.01, 0.02, 0.1, 0.842)),
    "author": ((0.06, 0.8, 0.06, 0.06, 0.02), (0.06, 0.75, 0.07, 0.06, 0.06), (0.08, 0.03, 0.07, 0.02, 0.8)),
    "doi": ((0.42, 0.4, 0.04, 0.06, 0.08), (0.42, 0.005, 0.005, 0.51, 0.06), (0.42, 0.003, 0.002, 0.515, 0.06)),
    "year": ((0.12, 0.82, 0.03, 0.03), (0.12, 0.6, 0.14, 0.14), (0.12, 0.14, 0.09, 0.65)),
    "words": ((0.79, 0.005, 0.01, 0.195), (0.02, 0.85, 0.09, 0.04), (0.005, 0.03, 0.05, 0.915)),
}
CLASSES, STRENGTH = (0.3, 0.1, 0.6), 30.0
#: Where the second class keeps its prior, as this is what the class means: another DOI, and a word that makes another work.
ANCHORED = ("doi", "words")
DAMPING, TOLERANCE, SAFETY = 0.3, 0.001, 300


def doi_of(value: Column) -> Column:
    """The DOI in lower case without its many wrappings."""
    value = F.lower(F.replace(F.lower(value), F.lit("%2f"), F.lit("/")))
    found = F.regexp_replace(F.regexp_extract(value, r"10\.\d{4,}/\S+", 0), r"[.,;)\s]+$", "")
    return F.when(found != "", found)


def _title_words(value: Column) -> Column:
    """The words of a title without mark-up; small Roman numerals as digits."""
    text = plain(F.regexp_replace(F.regexp_replace(value, r"<[^>]*>", " "), r"&(?:amp|#38);|&", " and "))
    for seen, meant in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        text = F.replace(text, F.lit(seen), F.lit(meant))
    words = F.filter(F.split(text, r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    digit = lambda w: F.array_position(F.array(*map(F.lit, _NUMERALS)), w).cast("string")
    return F.transform(words, lambda w: F.when(w.isin(*_NUMERALS), digit(w)).otherwise(w))


def _families(names: Column) -> Column:
    """Family names of authors joined by semicolons, in either order."""
    each = F.transform(F.split(names, ";"), lambda n: F.trim(plain(n)))
    last = lambda n: F.element_at(F.split(F.trim(F.when(n.contains(","), F.element_at(F.split(n, ","), 1)).otherwise(n)), r"\s+"), -1)
    return F.array_distinct(F.filter(F.transform(each, last), lambda w: (F.length(w) >= 3) & ~w.isin("al.", "al", *PARTICLES)))


def _name_words(name: Column) -> Column:
    words = F.split(F.regexp_replace(plain(name), r"[^\p{L}'’-]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin("dr", "prof", *PARTICLES)))


def left_records(papers: DataFrame, authors: DataFrame) -> DataFrame:
    """id, titles, dois, families, year of the papers; their authors are rows of another table. As depositors swap the
    parts of names, all words of a name count as possible family names here."""
    people = (
        authors.where("paper_id is not null")
        .select(
            F.col("paper_id").alias("id"), F.concat_ws(" ", "family", "given", "full_name").alias("name"),
            doi_of(F.col("doi")).alias("doi"), F.substring("issued", 1, 4).try_cast("int").alias("year"),
        )
        .groupBy("id")
        .agg(F.array_join(F.collect_set("name"), " ").alias("names"), F.collect_set("doi").alias("more"), F.min("year").alias("year"))
        .select("id", _name_words(F.col("names")).alias("families"), "more", "year")
    )
    own = (
        papers.where("paper_id is not null")
        .select(F.col("paper_id").alias("id"), F.col("title"), doi_of(F.col("doi")).alias("doi"))
        .groupBy("id")
        .agg(F.collect_set("title").alias("titles"), F.collect_set("doi").alias("own"))
    )
    none = F.array().cast("array<string>")
    return own.join(people, "id", "left").select(
        "id", "titles", F.array_union("own", F.coalesce("more", none)).alias("dois"), F.coalesce("families", none).alias("families"), "year"
    )


def right_records(nodes: DataFrame) -> DataFrame:
    """The same of the nodes of the other source."""
    return (
        nodes.where("id is not null")
        .select("id", "title", doi_of(F.col("doi")).alias("doi"), "authors", F.substring("pub_date", 1, 4).try_cast("int").alias("year"))
        .groupBy("id")
        .agg(
            F.collect_set("title").alias("titles"), F.collect_set("doi").alias("dois"),
            F.array_join(F.collect_set("authors"), ";").alias("authors"), F.min("year").alias("year"),
        )
        .select("id", "titles", "dois", F.coalesce(_families(F.col("authors")), F.array().cast("array<string>")).alias("families"), "year")
    )


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of one evidence as one with ``copies``, named by the least id; and ``id, member`` of every record."""
    fields, end = [F.sort_array(c).alias(c) for c in ("titles", "dois", "families")], F.lit("\x1e")
    whole = F.concat_ws("\x1f", "titles", end, "dois", end, "families", end, F.col("year").cast("string"))
    rows = written(records.select("id", *fields, "year").withColumn("digest", F.md5(whole)), "records")
    groups = rows.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    several = groups.where("copies > 1").select("digest", F.col("id").alias("first"))
    members = rows.select("digest", F.col("id").alias("member")).join(several, "digest").select(F.col("first").alias("id"), "member")
    return rows.join(groups.select("id", "copies"), "id").drop("digest"), members


def _variants(records: DataFrame) -> DataFrame:
    """One row for each title of a record; a record without one has one row with an empty title."""
    rows = records.select("*", F.explode_outer("titles").alias("title")).drop("titles")
    title = F.coalesce("title", F.lit(""))
    return rows.withColumn("words", _title_words(title)).withColumn("cut", title.rlike(r"(?:…|\.\.\.)\s*$")).drop("title")


def _with_content(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``content``: words in pairs that belong together as one, without those that many titles share;
    titles of fewer than three such words keep all. Both lists are shares of all titles, so they are bounded."""
    words = left.select("words").unionByName(right.select("words")).where(F.size("words") > 0)
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.get("words", i - 1), F.get("words", i)))
    units = F.array_distinct(F.concat("words", F.when(F.size("words") > 1, pairs).otherwise(F.array().cast("array<string>"))))
    total = words.count()
    n = written(words.select(F.explode(units).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= max(3, TOGETHER_SHARE * total)), "title-words")
    two = n.where(F.contains("w", F.lit(" "))).select("w", "n", F.substring_index("w", " ", 1).alias("a"), F.substring_index("w", " ", -1).alias("b"))
    of = lambda c: n.select(F.col("w").alias(c), F.col("n").alias(f"n_{c}"))
    joint = [r.w for r in two.join(of("a"), "a").join(of("b"), "b").where(F.col("n") >= TOGETHER * F.least("n_a", "n_b")).where(F.greatest("n_a", "n_b") < COMMON_SHARE * total).select("w").collect()]
    common = [r.w for r in n.where(~F.contains("w", F.lit(" ")) & (F.col("n") >= max(COMMON_LEAST, COMMON_SHARE * total))).select("w").collect()]

    def content(rows: DataFrame) -> DataFrame:
        glued = F.col("words")
        if joint:
            held = lambda w, i: F.concat(F.when((i > 0) & F.concat_ws(" ", F.get("words", i - 1), w).isin(*joint), "").otherwise(" "), w)
            glued = F.split(F.trim(F.array_join(F.transform("words", held), "")), " ")
        glued = F.when(F.size("words") > 0, F.array_distinct(glued)).otherwise(F.array().cast("array<string>"))
        kept = F.filter(glued, lambda w: ~w.isin(*common)) if common else glued
        return rows.withColumn("all", glued).withColumn("content", F.when(F.size(kept) >= 3, kept).otherwise(F.col("all"))).drop("all", "words")

    return content(left), content(right)


def _keys(rows: DataFrame, other: str, own: str) -> DataFrame:
    """id, key: hashes of what a candidate must share; keys marked ``own`` meet only the other side's records without
    authors, ``other`` says that mark of the other side."""
    none = F.array().cast("array<bigint>")
    # words that stand within ``reach`` of one another, anywhere in the title
    sets = lambda reach, k: F.filter(
        F.flatten(
            F.transform(
                "content",
                lambda w, i: F.array(*[
                    F.when(i + max(c) < F.size("content"), F.xxhash64(F.array_sort(F.array(w, *[F.get("content", i + o) for o in c])))) for c in itertools.combinations(range(1, reach), k - 1)
                ]),
            )
        ),
        lambda k: k.isNotNull(),
    )
    short = F.size("content").between(1, 2)
    single = F.when(short, F.transform("content", lambda w: F.xxhash64(w))).otherwise(none)
    rows = rows.select("id", "families", "dois", sets(5, 3).alias("triples"), F.concat(sets(3, 2), single).alias("parts"), F.when(short, F.array(F.lit(0).cast("long"))).otherwise(none).alias("bare"))
    named = F.flatten(F.transform("families", lambda f: F.transform(F.concat("parts", "bare"), lambda p: F.xxhash64(p, f))))
    lone = F.transform("parts", lambda p: F.xxhash64(F.lit(own), p))
    asked = F.when(F.size("families") == 0, F.transform("parts", lambda p: F.xxhash64(F.lit(other), p))).otherwise(none)
    whole = F.transform("dois", lambda d: F.xxhash64(F.lit("doi"), d))
    return rows.select("id", F.explode(F.concat("triples", named, lone, asked, whole)).alias("key"))


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """``l``, ``r``: pairs of ids that share a key. The frames hold ``id, dois, families, content``."""
    lk, rk = _keys(left, "r", "l").withColumnRenamed("id", "l"), _keys(right, "l", "r").withColumnRenamed("id", "r")
    return lk.join(rk, "key").select("l", "r").distinct()


def _near(x: Column, y: Column, cut: Column) -> Column:
    """A typing error or two apart, or the beginning where one title is cut."""
    return ((F.least(F.length(x), F.length(y)) >= 4) & (F.levenshtein(x, y, 2) >= 0) & ((F.length(x) >= 8) | (F.levenshtein(x, y, 2) <= 1) | (F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, ""))))) | (
        cut & (F.length(x) >= 3) & (F.length(y) >= 3) & (x.startswith(y) | y.startswith(x))
    )


def evidence(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """``l, r``, the words of either title that the other lacks (``dl``, ``dr``), how many words of the lesser title are
    met (``met``, by an error ``near``) of ``least``, the levels of authors, DOI and year, and the DOIs' registrants; of the
    variants of all pairs that share a DOI, or half of the words, or a third and an author."""
    side = lambda df, s: df.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("content", "cut", "dois", "families", "year")])
    both = pairs.join(side(left, "l"), "l").join(side(right, "r"), "r")
    a, b, fa, fb, da, db = (F.col(c) for c in ("content_l", "content_r", "families_l", "families_r", "dois_l", "dois_r"))
    both = both.withColumn("both", F.array_intersect(a, b)).withColumns({"shared": F.size("both"), "people": F.size(F.array_intersect(fa, fb)), "least": F.least(F.size(a), F.size(b)), "same": F.arrays_overlap(da, db)})
    gap = F.abs(F.col("year_l") - F.col("year_r"))
    lone = (F.size(fa) == 0) | (F.size(fb) == 0)
    begun = F.exists(da, lambda x: F.exists(db, lambda y: (F.length(x) >= 15) & (F.length(y) >= 15) & (x.startswith(y) | y.startswith(x))))
    both = both.where(
        F.col("same") | ((F.col("least") > 0) & ((F.col("shared") * 2 >= F.col("least")) & (~lone | gap.isNull() | (gap <= 2)) | ((F.col("shared") * 3 >= F.col("least")) | (F.col("least") <= 2)) & (F.col("people") > 0))) | begun
    )
    cut = F.col("cut_l") | F.col("cut_r")
    both = both.withColumns({"la": F.array_except(a, b), "lb": F.array_except(b, a)})
    both = both.withColumns(
        {
            "dl": F.filter("la", lambda x: ~F.exists("lb", lambda y: _near(x, y, cut))),
            "dr": F.filter("lb", lambda y: ~F.exists("la", lambda x: _near(x, y, cut))),
        }
    )
    near = F.exists(fa, lambda x: (F.length(x) >= 6) & F.exists(fb, lambda y: F.levenshtein(x, y, 2) >= 0))
    author = F.when(lone, 0).when(F.col("people") * 2 >= F.size(fb), 1).when(F.col("people") > 0, 2).when(near, 3).otherwise(4)
    doi = F.when((F.size(da) == 0) | (F.size(db) == 0), 0).when(F.col("same"), 1).when(begun, 2).otherwise(3)
    return both.select(
        "l", "r", "dl", "dr", F.size(a).alias("nl"), F.size(b).alias("nr"), (F.size("la") > F.size("dl")).alias("near"), author.alias("author"), doi.alias("doi"),
        F.when(gap.isNull(), 0).when(gap <= 1, 1).when(gap == 2, 2).otherwise(3).alias("year"),
        F.when(doi == 1, F.col("both")).otherwise(F.array().cast("array<string>")).alias("shared"), F.when(doi == 3, F.array_distinct(F.transform(F.concat(da, db), lambda d: F.substring_index(d, "/", 1)))).alias("registrants"),
        F.exists(F.concat(da, db), lambda d: d.contains("arxiv")).alias("early"),
    )


def _learned_words(pairs: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Labels; words that make another work of a title; words that often do. Learned from pairs of one DOI, and from
    pairs of different DOIs with the same authors and a title that holds the other. A word is judged if it stands in a
    given share of these pairs, so the lists are bounded."""
    alike = (F.col("author") == 1) & (F.col("doi") == 3) & (F.least(F.size("dl"), F.size("dr")) <= 1) & (F.greatest("nl", "nr") > 2)
    known = pairs.where((F.col("doi") == 1) | alike).select((F.col("doi") == 1).cast("int").alias("one"), F.concat("dl", "dr").alias("apart"), "shared")
    each = F.concat(
        F.transform(F.array_distinct("apart"), lambda w: F.struct(w.alias("w"), F.lit(1).alias("apart"))),
        F.transform(F.when(F.col("one") == 1, F.col("shared")).otherwise(F.array().cast("array<string>")), lambda w: F.struct(w.alias("w"), F.lit(0).alias("apart"))),
    )
    sizes = known.agg(F.sum("one"), F.sum(1 - F.col("one"))).first()
    same, other = sizes[0] or 0, sizes[1] or 0
    counts = (
        known.select("one", F.inline(each)).groupBy("w")
        .agg(F.sum(F.col("one") * F.col("apart")).alias("m"), F.sum((1 - F.col("one")) * F.col("apart")).alias("u"), F.sum(1 - F.col("apart")).alias("s"))
        .where(F.col("m") + F.col("u") >= max(3.0, WORD_SHARE * (same + other))).collect()
    )
    score = lambda r: np.log((r.m + 0.5) / (same + 1)) - np.log((r.u + 0.5) / (other + 1))
    labels = [r.w for r in counts if r.m >= 3 and r.m >= 4 * r.s and score(r) > -1]
    bad = [r.w for r in counts if score(r) <= -2]
    return labels, bad, [r.w for r in counts if -2 < score(r) <= -1]


def _learned_registrants(pairs: DataFrame, left: DataFrame, right: DataFrame) -> list[str]:
    """Registrants that stand in at least twice as many pairs of one title and authors with different DOIs as chance
    would put there, and in a hundredth of these pairs at least (so they are at most a few hundred)."""
    twins = pairs.where("author = 1 and doi = 3 and size(dl) = 0 and size(dr) = 0")
    n = twins.count()
    seen = twins.select(F.explode("registrants").alias("x")).groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= max(3.0, REGISTRANT_SHARE * n))
    dois = left.select("dois").unionByName(right.select("dois")).select(F.explode("dois").alias("d"))
    every = dois.groupBy(F.substring_index("d", "/", 1).alias("x")).agg(F.count("*").alias("of"))
    total = dois.count()
    return [r.x for r in seen.join(every, "x").collect() if r.n / n >= 2 * (1 - (1 - r.of / total) ** 2)]


def _levels(pairs: DataFrame, labels: list[str], bad: list[str], poor: list[str], second: list[str]) -> DataFrame:
    """``l, r, title, author, doi, year, words``: the levels of each pair.

    title: 0 missing, 1 the same words, 2 with errors, 3 one holds the other, 4 with errors, 5 four fifths of the lesser
    are met, 6 three fifths, 7 fewer. author: 0 missing, 1 half of the node's, 2 some, 3 a near spelling, 4 none. doi: 0
    missing, 1 the same, 2 a beginning, 3 another, 4 another where one is of a registrant of second versions. year: 0
    missing, 1 within a year, 2 two years apart, 3 more. words: 0 titles don't differ, 1 by a word that makes another
    work, 2 by one that often does, 3 by others.
    """
    isin = lambda w, words: w.isin(*words) if words else F.lit(False)
    labels = [*set(labels) | set(VERSIONS)]
    bad = [*(set(bad) | set(KINDS)) - set(labels)]
    true = lambda c: F.filter(c, lambda w: ~isin(w, labels))
    pairs = pairs.withColumns({"dl2": true("dl"), "dr2": true("dr")})
    a, b = F.size("dl2"), F.size("dr2")
    nl, nr = F.col("nl") - F.size("dl") + a, F.col("nr") - F.size("dr") + b
    met = F.least(nl - a, nr - b) / F.greatest(F.least(nl, nr), F.lit(1))
    hold = F.when(F.col("near"), F.lit(1)).otherwise(0)
    title = (
        F.when(F.least("nl", "nr") == 0, 0).when((a == 0) & (b == 0), 1 + hold).when(F.least(a, b) == 0, 3 + hold).when(met >= 0.8, 5).when(met >= 0.6, 6).otherwise(7)
    )
    apart = F.concat("dl2", "dr2")
    words = F.when((a == 0) & (b == 0), 0).when(F.exists(apart, lambda w: isin(w, bad)), 1).when(F.exists(apart, lambda w: isin(w, poor)), 2).otherwise(3)
    again = F.col("early") | (F.exists("registrants", lambda x: isin(x, second)))
    doi = F.when((F.col("doi") == 3) & again, 4).otherwise(F.col("doi"))
    return pairs.select("l", "r", title.alias("title"), "author", doi.alias("doi"), "year", words.alias("words"))


def weights(counts: np.ndarray, others: np.ndarray, patterns: np.ndarray, most: int = 10_000) -> np.ndarray:
    """The log odds that a pair of each pattern is one work, by expectation maximisation with prior counts.

    ``patterns``: a row of levels for each pattern, in the order of ``PRIOR``; ``counts``: its pairs that may be one work,
    ``others``: those that are not, as their node has a better one (the others of a node weigh as one). The product of the numbers of levels bounds the rows,
    whatever the data. ``most`` 1 gives the odds of the prior.
    """
    prior = [np.array(p) for p in PRIOR.values()]
    tables, share = [p / p.sum(1, keepdims=True) for p in prior], np.array(CLASSES)
    pseudo = STRENGTH * np.array(CLASSES)
    last = None
    for turn in range(most):
        logs = np.log(share)[:, None] + sum(np.log(t[:, patterns[:, f]]) for f, t in enumerate(tables))
        logs -= logs.max(0)
        gamma = np.exp(logs)
        gamma /= gamma.sum(0)
        if turn == most - 1:
            break
        strange = gamma[1:] / gamma[1:].sum(0)
        held = gamma * counts + np.concatenate([np.zeros((1, len(counts))), strange * others])
        tables = [
            np.stack([np.bincount(patterns[:, f], held[k], p.shape[1]) + pseudo[k] * p[k] / p[k].sum() for k in range(3)])
            for f, p in enumerate(prior)
        ]
        tables = [t / t.sum(1, keepdims=True) for t in tables]
        for f, name in enumerate(PRIOR):
            if name in ANCHORED:
                tables[f][1] = prior[f][1] / prior[f][1].sum()
        share = (held.sum(1) + pseudo) / (counts.sum() + others.sum() + pseudo.sum())
        if last is not None and np.abs(gamma - last).max() < 1e-6:
            break
        last = gamma
    same, rest = gamma[0], gamma[1:].sum(0)
    return np.log(np.maximum(same, 1e-12)) - np.log(np.maximum(rest, 1e-12))


def scored(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """``l, r, odds``: the log odds of each pair, of its best variants."""
    spark = left.sparkSession
    found = written(evidence(left, right, pairs), "evidence")
    names = list(PRIOR)
    levels = _levels(found, *_learned_words(found), _learned_registrants(found, left, right))

    def weighed(df: DataFrame, patterns: np.ndarray, odds: np.ndarray) -> DataFrame:
        rows = [(*map(int, p), float(o)) for p, o in zip(patterns, odds)]
        return df.join(F.broadcast(spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", odds double")), names)

    # where a node has a pair with an equal author, a near spelling is another person's name
    known = levels.where("author in (1, 2)").select("r").distinct().withColumn("known", F.lit(True))
    author = F.when((F.col("author") == 3) & F.col("known").isNotNull(), 4).otherwise(F.col("author"))
    levels = levels.join(known, "r", "left").withColumn("author", author).drop("known")
    every = np.array(list(itertools.product(*[range(len(p[0])) for p in PRIOR.values()])))
    first = written(weighed(levels, every, weights(np.zeros(len(every)), np.zeros(len(every)), every, 1)), "levels")
    # by the prior a node's best pair may be one work; its others are not, as a node has one paper at most, and count as one
    best = first.groupBy("r").agg(F.max("odds").alias("best"), F.count("*").alias("of"))
    other = F.col("odds") < F.col("best")
    counts = first.join(best, "r").groupBy(*names).agg(F.count_if(~other).alias("own"), F.sum(F.when(other, 1 / F.col("of")).otherwise(0.0)).alias("others")).collect()
    if not counts:
        return levels.select("l", "r", F.lit(0.0).alias("odds"))
    patterns = np.array([[r[n] for n in names] for r in counts], dtype=np.int64)
    odds = weights(*(np.array([r[c] for r in counts], dtype=float) for c in ("own", "others")), patterns)
    return weighed(first.drop("odds"), patterns, odds).groupBy("l", "r").agg(F.max("odds").alias("odds"))


def propagate(pairs: DataFrame, left_most: int = 2, right_most: int = 1) -> DataFrame:
    """``l, r, odds, confidence``: marginals under at most ``left_most`` partners of l and ``right_most`` of r (1 or 2).
    With ``nl`` and ``nr`` in ``pairs``, l and r stand for so many records with the same evidence.

    The message of a cardinality factor to one of its pairs is the log of (weight of the others when one place is taken)
    over (weight of the others), with weights from elementary symmetric sums of the others' incoming odds.
    """
    for c in ("nl", "nr"):
        pairs = pairs if c in pairs.columns else pairs.withColumn(c, F.lit(1))
    cap = lambda x: F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))
    once = lambda side, n: pairs.groupBy(side).agg(F.sum(n).alias("n")).where("n = 1").select(side)
    marked = pairs.join(once("l", "nr").withColumn("one_l", F.lit(True)), "l", "left").join(once("r", "nl").withColumn("one_r", F.lit(True)), "r", "left")
    marked = written(marked, "pairs")
    alone = F.coalesce(F.col("one_l") & F.col("one_r"), F.lit(False))
    state = marked.where(~alone).select("l", "r", "odds", "nl", "nr", F.lit(0.0).alias("from_l"), F.lit(0.0).alias("from_r"))

    def message(state: DataFrame, side: str, copies: str, incoming: Column, most: int, name: str) -> DataFrame:
        state = state.withColumn("w", F.exp(cap(incoming)))
        sums = state.groupBy(side).agg(F.sum(F.col("w") * F.col(copies)).alias("s1"), F.sum(F.col("w") * F.col("w") * F.col(copies)).alias("s2"))
        state = state.join(sums, side)
        e1 = F.greatest(F.col("s1") - F.col("w"), F.lit(0.0))
        e2 = F.greatest((e1 * e1 - F.greatest(F.col("s2") - F.col("w") * F.col("w"), F.lit(0.0))) / 2, F.lit(0.0))
        out = -F.log(1 + e1) if most == 1 else F.log(1 + e1) - F.log(1 + e1 + e2)
        return state.withColumn(name, out).drop("w", "s1", "s2")

    mixed = lambda old, new: DAMPING * F.col(old) + (1 - DAMPING) * F.col(new)
    for _ in range(SAFETY):
        state = message(state, "l", "nr", F.col("odds") + F.col("from_r"), left_most, "new_l")
        state = message(state, "r", "nl", F.col("odds") + F.col("from_l"), right_most, "new_r")
        moved = F.greatest(F.abs(F.col("new_l") - F.col("from_l")), F.abs(F.col("new_r") - F.col("from_r")))
        state = state.select("l", "r", "odds", "nl", "nr", mixed("from_l", "new_l").alias("from_l"), mixed("from_r", "new_r").alias("from_r"), moved.alias("moved"))
        state = written(state, "beliefs")
        moved = state.agg(F.max("moved")).first()[0]
        state = state.drop("moved")
        if moved is None or moved < TOLERANCE:
            break
    else:
        raise RuntimeError(f"messages still move after {SAFETY} rounds")
    settled = state.unionByName(marked.where(alone).select("l", "r", "odds", "nl", "nr", F.lit(0.0).alias("from_l"), F.lit(0.0).alias("from_r")))
    belief = cap(F.col("odds") + F.col("from_l") + F.col("from_r"))
    return settled.select("l", "r", "odds", (1 / (1 + F.exp(-belief))).alias("confidence"))


def matches(papers: DataFrame, authors: DataFrame, nodes: DataFrame, least_odds: float = -8.0, least: float = 0.0) -> DataFrame:
    """``paper_id, node_id, odds, confidence`` of all candidate pairs whose own evidence is not below ``least_odds`` and
    whose confidence is not below ``least``. As a node has one paper at most and a paper two nodes, records that are alike
    in all evidence share their confidence: from 0.5 on a pair of classes is at most two papers with four nodes."""
    lc, lm = classes(left_records(papers, authors))
    rc, rm = classes(right_records(nodes))
    left, right = _with_content(written(_variants(lc), "left"), written(_variants(rc), "right"))
    left, right = written(left, "left"), written(right, "right")
    pairs = scored(left, right, candidates(left, right)).where(F.col("odds") >= least_odds)
    of = lambda df, side: df.select(F.col("id").alias(side), F.col("copies").alias(f"n{side}")).distinct()
    pairs = pairs.join(of(lc, "l"), "l").join(of(rc, "r"), "r")
    found = propagate(pairs).where(F.col("confidence") >= least)
    named = lambda m, side: m.select(F.col("id").alias(side), F.col("member").alias(f"m{side}"))
    return (
        found.join(named(lm, "l"), "l", "left").join(named(rm, "r"), "r", "left")
        .select(F.coalesce("ml", "l").alias("paper_id"), F.coalesce("mr", "r").alias("node_id"), "odds", "confidence")
    )

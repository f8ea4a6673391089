"""Linking the spellings of names that people typed, by a noisy channel.

A spelling is a variant of a canonical form; frequent spellings are the candidates. A variant goes to the candidate of
maximum posterior: log frequency (the prior) plus the log likelihoods of the changes (typing error, initial, nickname,
dropped second name). The steps, each on distinct spellings with counts, not on rows:

1. Parse: family and given name from whichever fields are filled; accents, case, titles and particles fall away; tokens
   that are mostly given names elsewhere tell that the parts are in the wrong order.
2. Context: the place of the affiliation; where a mention has none, the places of the paper's other authors.
3. Family names: within a place, spellings that share a deletion key (one typing error apart) go to the likelier one.
4. Given names: within place and family name, initials, nicknames and errors go to their likeliest full form.
   Nicknames are learned: pairs of first names that stand for one another under several family names and places.
5. Mentions without a place go to the entity of maximum posterior among those of their paper's places and those of that
   name anywhere: its share of all mentions of the name is the prior, what the spelling lacks or changes the likelihood,
   and a place of the paper's other authors counts as evidence. An entity that holds less than half of a name is not taken.
6. Equal ORCIDs join entities, however long their chain. Organisations are compared as sets of words after each word went to its likeliest
   canonical word; abbreviations with a full stop go to the most frequent word that they begin.

Candidate pairs arise only from a shared key of a place and a deletion or initial, among distinct spellings; a name held
by a third of all rows is a few spellings with large counts.

Defined cases: mentions without any name have no links; blank fields count as null; repeated rows are linked like any
two mentions; rows without mention_id are left out; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import written

#: Words that mark an organisation's name, and signs of rank that are no part of a person's name.
ORG_WORDS = (
    "consortium", "collaboration", "collab", "cons", "initiative", "init", "institute", "inst", "laboratory", "lab", "group", "grp",
    "network", "project", "team", "society", "soc", "centre", "center", "association", "committee", "university", "univ", "foundation",
)
TITLES = ("dr", "prof", "mr", "mrs", "ms", "phd", "md", "jr", "sr", "ii", "iii")
#: Small words before a family name that are often left out.
PARTICLES = ("van", "der", "den", "de", "del", "della", "di", "da", "dos", "la", "le", "von", "zu", "zur", "ter", "ten", "bin", "al", "el", "af", "av")
#: Words of an affiliation that name no place, whatever the data; others are learned (:func:`placeless_words`).
PLACELESS = ("university", "univ", "institute", "inst", "technology", "tech", "dept", "department", "of", "the", "for", "and")
#: A word is placeless if it stands in this share of the distinct affiliations, and in so many; so the list is bounded.
PLACELESS_SHARE, PLACELESS_LEAST = 0.04, 40
#: Log likelihoods of the changes.
TYPO, INITIAL, NICKNAME, DROPPED, UNLIKE = -3.0, -1.0, -1.5, -0.7, -9.0
#: A nickname must stand for its name in so many (place, family name) groups, in one of them among few first names only,
#: or, as in groups of many names most pairs stand together by chance, so many times as often as chance would have it.
NICKNAME_GROUPS, NICKNAME_NAMES, NICKNAME_LIFT = 2, 6, 3.0
#: Log odds of a place that the paper's other authors name, and the share of a name's mentions that an entity must hold.
NEARBY, LEAST_SHARE = 6.0, 0.5


def _accents() -> tuple[str, str]:
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs) + "øØłŁđĐıþð", "".join(b for _, b in pairs) + "oOlLdDitd"


def plain(value: Column) -> Column:
    """Lower case without accents."""
    source, target = _accents()
    marks = "".join(map(chr, range(0x300, 0x370)))
    folded = F.translate(F.translate(value, source, target), marks, "")
    folded = F.replace(F.replace(folded, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae"))
    return F.lower(F.when(value.rlike(r"[^\x00-\x7F]"), folded).otherwise(value))  # most values are plain already


def _words(value: Column) -> Column:
    """Name words: letters with inner hyphens and apostrophes; initials apart, titles gone."""
    words = F.regexp_extract_all(plain(value), F.lit(r"\p{L}+(?:['’\-‐‑]\p{L}+)*"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*TITLES, *PARTICLES))


def _given_words(value: Column) -> Column:
    """Given names; two or three capitals without a vowel sound or a stop between are initials."""
    glued = F.regexp_replace(value, r"\b(\p{Lu})(\p{Lu})\b", "$1 $2")
    return _words(glued)


def deletions(value: Column) -> Column:
    """The value and all that is left of it without one letter: values one typing error apart share one."""
    n = F.length(value)
    shorter = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(value.substr(F.lit(1), i - 1), value.substr(i + 1, n)))
    return F.when(n >= 4, F.array_distinct(F.concat(F.array(value), shorter))).otherwise(F.array(value))


def family_keys(value: Column) -> Column:
    """The deletion keys of a family name, and of the parts of a double one."""
    parts = F.split(value, "[-‐‑]")
    return F.array_distinct(F.concat(deletions(value), F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))))


def _same_family(a: Column, b: Column) -> Column:
    """One typing error apart, or one the part of the other's double name."""
    return _near(a, b) | F.array_contains(F.split(a, "[-‐‑]"), b) | F.array_contains(F.split(b, "[-‐‑]"), a)


def _family_cost(a: Column, b: Column) -> Column:
    return F.when(_near(a, b), TYPO * F.levenshtein(a, b)).otherwise(DROPPED)


def placeless_words(df: DataFrame) -> list[str]:
    """Words that stand in many distinct affiliations, as only words for kinds of institutions do."""
    distinct = df.select(plain(F.col("affiliation")).alias("a")).where("a <> ''").distinct()
    words = distinct.select("a", F.explode(F.array_distinct(F.regexp_extract_all("a", F.lit(r"\p{L}+"), F.lit(0)))).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= PLACELESS_LEAST)
    total = distinct.count()
    return [r.w for r in counts.where(F.col("n") >= PLACELESS_SHARE * total).collect()]


def place_of(affiliation: Column, placeless: tuple[str, ...] = PLACELESS) -> Column:
    """What names a place in the last part of an affiliation."""
    words = F.regexp_extract_all(F.substring_index(plain(affiliation), ",", -1), F.lit(r"\p{L}+"), F.lit(0))
    place = F.array_join(F.filter(words, lambda w: ~w.isin(*placeless)), " ")
    return F.when(place != "", place)


def parsed(df: DataFrame, placeless: tuple[str, ...] = PLACELESS) -> DataFrame:
    """mention_id, paper_id, orcid, place, is_org, words (of an organisation), given (words), family (last word)."""
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    df = df.where(F.col("mention_id").isNotNull()).select(
        "mention_id", "paper_id", blank("orcid").alias("orcid"), place_of(blank("affiliation"), placeless).alias("place"),
        blank("given").alias("g"), blank("family").alias("f"), blank("full_name").alias("n"),
    )
    alone = F.col("f").isNull() & F.col("g").isNull()
    org_word = F.exists(_words(F.col("n")), lambda w: w.isin(*ORG_WORDS))
    comma = F.split(F.col("n"), ",")
    full = _given_words(F.regexp_replace("n", ",", " "))
    return (
        df.where(~alone | F.col("n").isNotNull())
        .withColumn("is_org", alone & (org_word | ~F.contains(F.col("n"), F.lit(","))))
        .withColumn("family_words", F.when(F.col("f").isNotNull(), _words(F.col("f"))).when(alone, _words(F.get(comma, F.lit(0)))))
        .withColumn(
            "given_words",
            F.when(F.col("g").isNotNull(), _given_words(F.col("g")))
            .when(alone, _given_words(F.get(comma, F.lit(1))))
            .when(F.col("n").isNotNull(), F.array_except(full, F.col("family_words"))),
        )
        .withColumn("family_words", F.coalesce("family_words", F.array_except(full, F.col("given_words")), F.array().cast("array<string>")))
        .withColumn("given_words", F.coalesce("given_words", F.array().cast("array<string>")))
        .select("mention_id", "paper_id", "orcid", "place", "is_org", F.col("n").alias("full_name"), "given_words", "family_words")
    )


def _in_order(people: DataFrame) -> DataFrame:
    """Puts swapped parts in order: words that are given names in most other mentions are given names here."""
    people = people.withColumn("a", F.get("given_words", F.lit(0))).withColumn("z", F.get(F.reverse("family_words"), F.lit(0)))
    uses = (
        people.select(F.inline(F.array(F.struct(F.col("a").alias("w"), F.lit(1).alias("as_given")), F.struct(F.col("z").alias("w"), F.lit(0).alias("as_given")))))
        .where(F.length("w") > 2)
        .groupBy("w")
        .agg(F.sum("as_given").alias("as_given"), F.sum(1 - F.col("as_given")).alias("as_family"))
        .select("w", (F.log(F.col("as_given") + 0.5) - F.log(F.col("as_family") + 0.5)).alias("lean"))
    )
    spellings = people.select("a", "z").distinct()
    lean_of = lambda c: uses.select(F.col("w").alias(c), F.col("lean").alias(f"lean_{c}"))
    short = lambda c: F.length(c) <= 2
    turned = (
        spellings.join(lean_of("a"), "a", "left")
        .join(lean_of("z"), "z", "left")
        .withColumn(
            "turned",
            F.when(short("z") & ~short("a"), True)
            .when(short("a") & ~short("z"), F.coalesce(F.col("lean_z") > 2.5, F.lit(False)))
            .otherwise(F.coalesce(F.col("lean_z"), F.lit(0.0)) - F.coalesce(F.col("lean_a"), F.lit(0.0)) > 2.0),
        )
        .where("turned")
        .select("a", "z", "turned")
    )
    people = people.join(turned, (people.a.eqNullSafe(turned.a)) & (people.z.eqNullSafe(turned.z)), "left").drop(turned.a).drop(turned.z)
    swap = F.col("turned").isNotNull()
    given, family = F.when(swap, F.col("family_words")).otherwise(F.col("given_words")), F.when(swap, F.col("given_words")).otherwise(F.col("family_words"))
    return people.select(
        "mention_id", "paper_id", "orcid", "place", F.coalesce(F.get(F.reverse(family), F.lit(0)), F.lit("")).alias("s"),
        F.coalesce(F.get(given, F.lit(0)), F.lit("")).alias("g1"), F.coalesce(F.get(given, F.lit(1)), F.lit("")).alias("g2"),
    )


def _near(a: Column, b: Column) -> Column:
    """One typing error apart (a swap of neighbours counts two single edits)."""
    return F.levenshtein(a, b) <= 2


def _roots(links: DataFrame, keys: list[str]) -> DataFrame:
    """Follows each spelling's link to the likelier one up to its end; links lead to likelier spellings only, so there are
    no circles, and every round doubles the way gone."""
    targets = [f"to_{k}" for k in keys]
    links = written(links, "roots")
    while True:
        nxt = links.select(*[F.col(k).alias(f"to_{k}") for k in keys], *[F.col(f"to_{k}").alias(f"next_{k}") for k in keys], F.lit(True).alias("on"))
        step = links.join(nxt, targets, "left").select(*keys, *[F.coalesce(f"next_{k}", f"to_{k}").alias(f"to_{k}") for k in keys], "on")
        step = written(step, "roots", replaces=links)
        links = step.drop("on")
        links._written_at = step._written_at
        if step.where("on").isEmpty():
            return links


def family_links(forms: DataFrame) -> DataFrame:
    """place, s -> to_s: the likelier spelling of a family name at the same place. ``forms``: place, s, n."""
    units = forms.groupBy("place", "s").agg(F.sum("n").alias("n"))
    keyed = written(units.select("place", "s", "n", F.explode(family_keys(F.col("s"))).alias("key")), "family-keys")
    v, c = keyed.alias("v"), keyed.alias("c")
    likelier = (F.col("c.n") > F.col("v.n")) | ((F.col("c.n") == F.col("v.n")) & (F.col("c.s") < F.col("v.s")))
    links = (
        v.join(c, (F.col("v.place") == F.col("c.place")) & (F.col("v.key") == F.col("c.key")) & likelier)
        .where(_same_family(F.col("v.s"), F.col("c.s")) & (F.length("v.s") >= 4))
        .groupBy("v.place", "v.s")
        .agg(F.max_by(F.col("c.s"), F.struct(F.log(F.col("c.n")) + _family_cost(F.col("v.s"), F.col("c.s")), F.col("c.s"))).alias("to_s"))
        .select("place", "s", F.col("place").alias("to_place"), "to_s")
    )
    return _roots(links, ["place", "s"]).select("place", "s", "to_s")


def nicknames(forms: DataFrame) -> DataFrame:
    """g1 -> full: first names that stand for one another under several names and places. ``forms``: place, s, g1, n.

    Pairs of all groups are counted, whatever the group's size. A pair is known if a group of few names shows it, or if it
    stands together more often than names of groups of such sizes would by chance."""
    names = forms.where(F.length("g1") > 2).select("place", "s", "g1").distinct()
    sizes = names.groupBy("place", "s").agg(F.count("*").alias("size")).where("size > 1")
    names = written(names.join(sizes, ["place", "s"]), "first-names")
    # meetings: with how many names a name stands in all its groups; the chance that one of them is ``full`` is its share of all
    uses = names.groupBy("g1").agg(F.count("*").alias("groups"), F.sum(F.col("size") - 1).alias("meetings")).where(F.col("groups") >= NICKNAME_GROUPS)
    uses = written(uses, "first-name-uses")
    often = names.join(uses.select("g1"), "g1", "left_semi")
    pairs = (
        often.join(often.select("place", "s", F.col("g1").alias("full")), ["place", "s"]).where("g1 < full").where(F.levenshtein("g1", "full") > 1)
        .groupBy("g1", "full").agg(F.count("*").alias("n"), F.min("size").alias("least")).where(F.col("n") >= NICKNAME_GROUPS)
    )
    few = pairs.where(F.col("least") <= NICKNAME_NAMES).select("g1", "full")
    total = names.agg(F.count("*").alias("total"))
    of = uses.select(F.col("g1").alias("full"), F.col("groups").alias("held"))
    chance = F.col("meetings") * F.col("held") / F.col("total")
    beyond = (
        pairs.where(F.col("least") > NICKNAME_NAMES).join(uses.select("g1", "meetings"), "g1").join(of, "full").crossJoin(F.broadcast(total))
        .where(F.col("n") >= NICKNAME_LIFT * chance).select("g1", "full")
    )
    known = few.unionByName(beyond)
    return known.unionByName(known.select(F.col("full").alias("g1"), F.col("g1").alias("full")))


def given_links(forms: DataFrame, known: DataFrame) -> DataFrame:
    """place, s, g1, g2 -> to_g1, to_g2: the likelier given names of the same place and family name."""
    forms = written(forms.groupBy("place", "s", "g1", "g2").agg(F.sum("n").alias("n")), "given-forms")
    short = F.length("g1") <= 2
    own = F.when(F.col("g1") == "", F.array(F.lit("*"))).when(short, F.array(F.concat(F.lit("."), F.substring("g1", 1, 1)))).otherwise(deletions(F.col("g1")))
    asks = forms.select("*", F.explode(own).alias("key"), F.lit(0.0).alias("cost"))
    nick = forms.where(~short).join(known, "g1").select(*forms.columns, F.col("full").alias("key"), F.lit(NICKNAME).alias("cost"))
    initial = F.array(F.concat(F.lit("."), F.substring("g1", 1, 1)), F.lit("*"))
    gives = forms.select("*", F.explode(F.when(short, initial).otherwise(F.concat(deletions(F.col("g1")), initial))).alias("key"))
    # a nickname also answers to the initial of the name that it stands for
    called = forms.where(~short).join(known, "g1").select(*forms.columns, F.concat(F.lit("."), F.substring("full", 1, 1)).alias("key")).distinct()
    v, c = asks.unionByName(nick).alias("v"), gives.unionByName(called).alias("c")
    weight = lambda t: F.length(F.col(f"{t}.g1")) > 2
    fuller = (weight("c") & ~weight("v")) | (
        (weight("c") == weight("v"))
        & (
            (F.col("c.n") > F.col("v.n"))
            | ((F.col("c.n") == F.col("v.n")) & (F.struct(F.length("c.g2"), "c.g1", "c.g2") > F.struct(F.length("v.g2"), "v.g1", "v.g2")))
        )
    )
    first = (
        F.when(F.col("v.g1") == F.col("c.g1"), 0.0)
        .when(F.col("v.g1") == "", DROPPED)
        .when(F.length("v.g1") <= 2, INITIAL)
        .when(F.col("v.cost") < 0, F.when(F.col("c.g1") == F.col("v.key"), F.col("v.cost")).otherwise(UNLIKE))
        .when(_near(F.col("v.g1"), F.col("c.g1")), TYPO)
        .otherwise(UNLIKE)
    )
    a, b = F.col("v.g2"), F.col("c.g2")
    second = (
        F.when(a == b, 0.0)
        .when((a == "") | (b == ""), DROPPED)
        .when(((F.length(a) <= 2) | (F.length(b) <= 2)) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)), INITIAL)
        .when(_near(a, b), TYPO)
        .otherwise(UNLIKE)
    )
    score = F.log(F.col("c.n")) + first + second
    links = (
        v.join(c, (F.col("v.place") == F.col("c.place")) & (F.col("v.s") == F.col("c.s")) & (F.col("v.key") == F.col("c.key")) & fuller)
        .where((first + second) > UNLIKE + 1)
        .groupBy("v.place", "v.s", "v.g1", "v.g2")
        .agg(F.max_by(F.struct("c.g1", "c.g2"), F.struct(score, "c.g1", "c.g2")).alias("to"))
        .select("place", "s", "g1", "g2", F.col("place").alias("to_place"), F.col("s").alias("to_s"), F.col("to.g1").alias("to_g1"), F.col("to.g2").alias("to_g2"))
    )
    return _roots(links, ["place", "s", "g1", "g2"]).select("place", "s", "g1", "g2", "to_g1", "to_g2")


def _org_entities(orgs: DataFrame) -> DataFrame:
    """mention_id, entity of organisations: the sorted set of their canonical words."""
    text = F.regexp_replace("full_name", r"\([^)]*\)", " ")
    words = F.regexp_extract_all(plain(text), F.lit(r"\p{L}+\.?"), F.lit(0))
    words = F.filter(words, lambda w: ~w.isin("the", "of", "for", "and", "de"))
    listed = written(orgs.select("mention_id", F.explode(words).alias("w")), "org-words")
    counts = listed.groupBy("w").agg(F.count("*").alias("n"))
    whole = counts.where(~F.endswith("w", F.lit(".")))
    cut = counts.where(F.endswith("w", F.lit("."))).select("w", F.expr("substring(w, 1, length(w) - 1)").alias("stem"))
    prefixes = whole.select(F.col("w").alias("word"), "n", F.explode(F.expr("transform(sequence(3, greatest(3, length(w))), i -> substring(w, 1, i))")).alias("stem"))
    expanded = (
        cut.join(prefixes, "stem", "left")
        .groupBy("w", "stem")
        .agg(F.max_by("word", F.struct("n", "word")).alias("word"))
        .select("w", F.coalesce("word", "stem").alias("word"))
    )
    keyed = whole.where(F.length("w") >= 4).select("w", "n", F.explode(deletions(F.col("w"))).alias("key"))
    v, c = keyed.alias("v"), keyed.alias("c")
    corrected = (
        v.join(c, (F.col("v.key") == F.col("c.key")) & (F.col("c.n") > F.col("v.n")))
        .where(_near(F.col("v.w"), F.col("c.w")))
        .groupBy("v.w")
        .agg(F.max_by("c.w", F.struct(F.log(F.col("c.n")) + TYPO * F.levenshtein("v.w", "c.w"), "c.w")).alias("word"))
    )
    canonical = corrected.unionByName(expanded).select("w", "word")
    twice = canonical.select(F.col("w").alias("word"), F.col("word").alias("again"))
    canonical = written(canonical.join(twice, "word", "left").select("w", F.coalesce("again", "word").alias("word")), "org-canonical")
    return (
        listed.join(canonical, "w", "left")
        .groupBy("mention_id")
        .agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("word", "w"))), " ").alias("bag"))
        .select("mention_id", F.concat(F.lit("org|"), "bag").alias("entity"))
    )


def _name_keys(g1: Column, g2: Column, forms: Column, s: Column, free: Column | None = None) -> Column:
    """``key, cost``: the looks of a name under which an entity is looked up, with the log likelihood of what each leaves
    out: the whole name, without second names, a near family name (``forms``: its deletion keys), the initial alone. Of an
    entity's name (without ``free``) all of them; of a mention's those that it may use."""
    full = F.length(g1) > 2
    look = lambda mark, *parts: F.xxhash64(F.lit(mark), *parts)
    initial = F.struct(look("i", s, F.substring(g1, 1, 1)).alias("key"), F.when(full, TYPO - 1).otherwise(INITIAL).alias("cost"))
    near = F.transform(forms, lambda k: F.struct(look("n", k, g1).alias("key"), F.lit(TYPO).alias("cost")))
    one = lambda key, cost: F.array(F.struct(key.alias("key"), F.lit(cost).alias("cost")))
    none = F.array().cast("array<struct<key:bigint,cost:double>>")
    return F.concat(
        one(look("w", s, g1, g2), 0.0), one(look("g", s, g1), DROPPED), F.when(full, near).otherwise(none),
        F.array(initial) if free is None else F.when(free, F.array(initial)).otherwise(none),
    )


def entities(df: DataFrame) -> DataFrame:
    """``mention_id, entity``: equal entities name the same person or organisation."""
    rows = written(parsed(df, tuple({*PLACELESS, *placeless_words(df)})), "parsed")
    orgs = _org_entities(rows.where("is_org"))
    people = written(_in_order(rows.where(~F.col("is_org"))).where("s <> '' or g1 <> ''"), "people")

    # context: the mention's own place, else those of its paper
    placed = people.where("place is not null")
    forms = written(placed.groupBy("place", "s", "g1", "g2").agg(F.count("*").alias("n")), "forms")
    families = family_links(forms)
    forms = written(
        forms.join(families, ["place", "s"], "left").select("place", F.col("s").alias("typed"), F.coalesce("to_s", "s").alias("s"), "g1", "g2", "n"), "forms"
    )
    givens = given_links(forms, written(nicknames(forms), "nicknames"))
    resolved = written(
        forms.join(givens, ["place", "s", "g1", "g2"], "left").select(
            "place", "typed", "s", "g1", "g2", "n",
            F.concat_ws("|", F.lit("person"), "place", "s", F.coalesce("to_g1", "g1"), F.coalesce("to_g2", "g2")).alias("entity"),
        ),
        "resolved",
    )
    first = placed.join(resolved.select("place", F.col("typed").alias("s"), "g1", "g2", "entity"), ["place", "s", "g1", "g2"]).select("mention_id", "orcid", "entity")
    loose = written(people.where("place is null").select("mention_id", "paper_id", "orcid", "s", "g1", "g2", F.col("orcid").isNull().alias("free")), "loose")
    at_places, anywhere = _near_entities(people, loose, resolved), _known_entities(loose, resolved)
    best = at_places.unionByName(anywhere).groupBy("mention_id").agg(F.max_by("entity", F.struct("score", "entity")).alias("entity"))
    rest = loose.join(best, "mention_id", "left").select(
        "mention_id", "orcid", F.coalesce("entity", F.concat_ws("|", F.lit("person"), F.lit(""), "s", "g1", "g2")).alias("entity")
    )
    assigned = written(first.unionByName(rest), "assigned")
    return _joined_by_orcid(assigned).unionByName(orgs)


def _near_entities(people: DataFrame, loose: DataFrame, resolved: DataFrame) -> DataFrame:
    """``mention_id, entity, score``: the best entities at the places of the paper, found for each distinct name and place."""
    near = people.where("place is not null").select("paper_id", "place").distinct()
    asked = written(loose.select("mention_id", "paper_id", "s", "g1").join(near, "paper_id").select("mention_id", "place", "s", "g1"), "asked")
    units = resolved.groupBy("place", "typed", "g1", "entity").agg(F.sum("n").alias("n")).withColumn("key", F.explode(family_keys(F.col("typed"))))
    a, c = asked.select("place", "s", "g1").distinct().withColumn("key", F.explode(family_keys(F.col("s")))).alias("a"), units.alias("c")
    letters = lambda c: F.substring(c, 1, 1)
    alike = (
        F.when(F.col("a.g1") == F.col("c.g1"), 0.0)
        .when(F.col("a.g1") == "", DROPPED)
        .when(((F.length("a.g1") <= 2) | (F.length("c.g1") <= 2)) & (letters("a.g1") == letters("c.g1")), INITIAL)
        .when(_near(F.col("a.g1"), F.col("c.g1")) & (F.length("a.g1") >= 4), TYPO)
        .otherwise(TYPO - 2)
    )
    score = F.log("c.n") + alike + _family_cost(F.col("a.s"), F.col("c.typed")) + NEARBY
    best = (
        a.join(c, (F.col("a.place") == F.col("c.place")) & (F.col("a.key") == F.col("c.key")))
        .where(_same_family(F.col("a.s"), F.col("c.typed")))
        .groupBy("a.place", "a.s", "a.g1")
        .agg(F.max(F.struct(score.alias("score"), F.col("c.entity").alias("entity"))).alias("best"))
    )
    return asked.join(best, ["place", "s", "g1"]).select("mention_id", "best.entity", "best.score")


def _known_entities(loose: DataFrame, resolved: DataFrame) -> DataFrame:
    """``mention_id, entity, score``: entities that hold most of a name anywhere, found for each distinct name. Of a name's
    holders only the first and the sum are kept, so a name of many holders is one row."""
    units = loose.select("s", "g1", "g2", "free").distinct()
    asks = units.select("s", "g1", "g2", "free", F.inline(_name_keys(F.col("g1"), F.col("g2"), family_keys(F.col("s")), F.col("s"), F.col("free"))))
    asks = written(asks, "name-keys")
    names = resolved.groupBy(F.col("typed").alias("s"), "g1", "g2", "entity").agg(F.sum("n").alias("n"))
    looks = names.select("entity", "n", F.inline(_name_keys(F.col("g1"), F.col("g2"), family_keys(F.col("s")), F.col("s"))))
    looks = looks.join(asks.select("key").distinct(), "key", "left_semi").groupBy("key", "entity").agg(F.sum("n").alias("n"))
    held = looks.groupBy("key").agg(F.max(F.struct("n", "entity")).alias("most"), F.sum("n").alias("total"))
    held = held.where(F.col("most.n") > LEAST_SHARE * F.col("total")).select("key", "most.entity", F.log(F.col("most.n") / F.col("total")).alias("share"))
    best = asks.join(held, "key").groupBy("s", "g1", "g2", "free").agg(F.max(F.struct((F.col("share") + F.col("cost")).alias("score"), "entity")).alias("best"))
    return loose.join(best, ["s", "g1", "g2", "free"]).select("mention_id", "best.entity", "best.score")


def _joined_by_orcid(assigned: DataFrame) -> DataFrame:
    """Entities that share an ORCID become one: the least name travels between them until none changes."""
    edges = written(assigned.where("orcid is not null").select("entity", "orcid").distinct(), "orcids")
    # an entity of one ORCID that no other has needs no step
    single = edges.groupBy("orcid").agg(F.count("*").alias("n")).where("n > 1").select("orcid")
    edges = written(edges.join(single, "orcid", "left_semi"), "orcids", replaces=edges)
    label = written(edges.select("entity").distinct().select("entity", F.col("entity").alias("label"), F.lit(True).alias("moved")), "labels")
    while not label.where("moved").isEmpty():
        by_orcid = edges.join(label, "entity").groupBy("orcid").agg(F.min("label").alias("least"))
        least = edges.join(by_orcid, "orcid").groupBy("entity").agg(F.min("least").alias("least"))
        label = written(label.join(least, "entity").select("entity", F.col("least").alias("label"), (F.col("least") < F.col("label")).alias("moved")), "labels", replaces=label)
    return assigned.join(label, "entity", "left").select("mention_id", F.coalesce("label", "entity").alias("entity"))


def linked_pairs(df: DataFrame) -> DataFrame:
    """``mention_id_1, mention_id_2`` of all mentions of one entity, the smaller first."""
    members = written(entities(df).distinct(), "members")
    a, b = members.alias("a"), members.alias("b")
    return (
        a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.mention_id") < F.col("b.mention_id")))
        .select(F.col("a.mention_id").alias("mention_id_1"), F.col("b.mention_id").alias("mention_id_2"))
    )

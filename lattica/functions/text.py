"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verbs that relation names reduce to.
VERBS = {
    "use": "use", "uses": "use", "using": "use", "used": "use",
    "apply": "apply", "applies": "apply", "applying": "apply", "applied": "apply",
    "include": "include", "includes": "include", "including": "include", "included": "include",
    "contain": "contain", "contains": "contain", "containing": "contain", "contained": "contain",
    "belong": "belong", "belongs": "belong", "belonging": "belong", "belonged": "belong",
    "is": "be", "are": "be", "was": "be", "were": "be", "been": "be",
    "has": "have", "have": "have", "had": "have",
}

#: The default clean-up rules, in their order.
CLEANUP = (
    (r"^[\"']+|['\"]+$", ""),
    (r"^[$#*:;.,!?@%^&()\[\]{}|\-_=+~`]+", ""),
    (r"[$#*:;.,!?@%^&()\[\]{}|\-_=+~`]+$", ""),
    (r":node[_-]", ""),
    (r"^a\s+", ""),
    (r"^all\s+", ""),
)


@cache
def _compatibility() -> tuple[str, str, list[tuple[str, str]]]:
    """From the character database: characters that fold to one ASCII character, and those that fold to several. A text's
    decomposition is that of its characters, as what reordering touches is no ASCII."""
    source, target, several = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        folded = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        elif folded:
            several.append((char, folded))
    return "".join(source), "".join(target), several


def _class_of(chars: list[str]) -> str:
    """A character class of the characters, neighbours as ranges."""
    codes, ranges = sorted(map(ord, chars)), []
    for code in codes:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(chr(a) + "-" + chr(z) for a, z in ranges) + "]"


def ascii_fold(value: Column) -> Column:
    """ASCII part of the compatibility decomposition."""
    source, target, several = _compatibility()

    def unfolded(value: Column, pairs: list[tuple[str, str]]) -> Column:
        listed = F.from_json(F.lit(json.dumps([{"c": c, "f": f} for c, f in pairs])), "array<struct<c:string,f:string>>")  # one literal
        return F.aggregate(listed, value, lambda v, p: F.replace(v, p["c"], p["f"]))

    # most values are ASCII, most others have none of the characters that fold to several, and most of these only such as
    # ellipses, ligatures and fractions: the steps that a value doesn't need are skipped
    usual = [p for p in several if ord(p[0]) < 0x2190 or 0xFB00 <= ord(p[0]) <= 0xFB06]
    rare = [p for p in several if p not in usual]
    long = F.when(value.rlike(_class_of([c for c, _ in rare])), unfolded(value, several)).when(value.rlike(_class_of([c for c, _ in usual])), unfolded(value, usual))
    folded = F.regexp_replace(F.translate(F.coalesce(long, value), source, target), r"[^\x00-\x7F]", "")
    return F.when(value.rlike(r"[^\x00-\x7F]"), folded).otherwise(value)


def match_key(value: Column) -> Column:
    """Folded to ASCII, lower case, without punctuation, spaces squeezed: equal for spellings of one name."""
    value = F.regexp_replace(F.lower(ascii_fold(value)), r"[^\w\s]", "")
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def entity_canonical(value: Column, exclusions: tuple[str, ...] = ()) -> Column:
    """Each word lower and singular; words of two to five capitals stay; ``exclusions`` are only put in lower case."""

    def word(w: Column) -> Column:
        low = F.lower(w)
        cut = lambda n: F.substring(low, F.lit(1), F.length(low) - n)
        singular = (
            F.when(low.endswith("ies"), F.concat(cut(3), F.lit("y")))
            .when(low.rlike("(?:ches|shes|sses|xes|zes)$"), cut(2))
            .when(low.endswith("es"), cut(1))
            .when(low.endswith("s") & ~low.rlike("(?:ss|us|is)$"), cut(1))
            .otherwise(low)
        )
        plain = low.isin(*exclusions) if exclusions else F.lit(False)
        return F.when(plain, low).when(w.rlike(r"^\p{Lu}{2,5}$"), w).otherwise(singular)

    words = F.filter(F.split(F.trim(value), r"(?U)\s+"), lambda w: w != "")
    return F.when(F.trim(value) == "", value).otherwise(F.array_join(F.transform(words, word), " "))


def relation_canonical(value: Column, exclusions: tuple[str, ...] = ()) -> Column:
    """snake_case with each part reduced towards a base verb."""
    verbs = F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair])

    def part(p: Column) -> Column:
        n = F.length(p)
        cut = lambda k: F.substring(p, F.lit(1), n - k)
        stem = (
            F.when(p.endswith("ing") & (n > 5), cut(3))
            .when((p.endswith("ed") | p.endswith("es")) & (n > 5), cut(2))
            .when(p.endswith("s") & ~p.rlike("(?:ss|us|is)$") & (n > 4), cut(1))
            .otherwise(p)
        )
        plain = p.isin(*exclusions) if exclusions else F.lit(False)
        return F.when(plain, p).otherwise(F.coalesce(F.try_element_at(verbs, p), stem))

    parts = F.split(F.regexp_replace(F.lower(F.trim(value)), r"(?U)[\s\-]+", "_"), "_")
    joined = F.regexp_replace(F.array_join(F.transform(parts, part), "_"), "_+", "_")
    return F.when(value == "", value).otherwise(F.btrim(joined, F.lit("_")))


def clean_up(value: Column, rules: tuple[tuple[str, str], ...] = CLEANUP) -> Column:
    """The rules one after the other, without regard to case; blank values stay."""
    cleaned = reduce(lambda v, r: F.regexp_replace(v, "(?iU)" + r[0], r[1]), rules, value)
    return F.when(F.trim(value) == "", value).otherwise(cleaned)


def title_key(value: Column) -> Column:
    """Without tags, lower case, only letters a-z, digits and single spaces."""
    value = F.regexp_replace(F.lower(F.regexp_replace(value, "<[^>]+>", "")), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def date_parts(parts: Column) -> Column:
    """[year, month, day] as YYYY[-MM[-DD]], padded."""
    padded = F.transform(parts, lambda p, i: F.when(i == 0, p.cast("string")).otherwise(F.lpad(p.cast("string"), 2, "0")))
    return F.when(F.size(parts) > 0, F.array_join(F.slice(padded, 1, 3), "-"))


def first_date(*candidates: Column) -> Column:
    """The first date that is there: print, online, created."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in candidates])


def authors_text(authors: Column) -> Column:
    """'; '-joined names of structs with given, family and name."""
    full = lambda a: F.coalesce(
        F.when(a["given"].isNotNull() & a["family"].isNotNull(), F.concat_ws(" ", a["given"], a["family"])), a["name"]
    )
    return F.array_join(F.filter(F.transform(authors, full), lambda n: n.isNotNull()), "; ")


def scholar_id(doi: Column) -> Column:
    """The identifier of a paper for a scholarly graph service: arXiv DOIs by their number, others by DOI."""
    arxiv = F.regexp_extract(doi, r"(?i)^10\.48550/arxiv\.(.+)$", 1)
    return F.when(arxiv != "", F.concat(F.lit("ARXIV:"), arxiv)).otherwise(F.concat(F.lit("DOI:"), doi))


def doi_of_ids(arxiv: Column, doi: Column) -> Column:
    """A DOI from external ids, arXiv preferred."""
    return F.coalesce(F.when(arxiv.isNotNull(), F.concat(F.lit("10.48550/arXiv."), arxiv)), doi)


def second_token(value: Column) -> Column:
    """The second word, without a leading ``doi:``."""
    return F.regexp_replace(F.get(F.split(value, " "), F.lit(1)), "^doi:", "")


#: What an HTML tag becomes; ``\ue000`` and ``\ue001`` take the white space after and before them away.
_MARKS = {f"h{n}": "\n" + "#" * n + " \ue000" for n in range(1, 5)} | {f"/h{n}": "\ue001\n" for n in range(1, 5)} | {
    "pre": "\n```\n\ue000", "/pre": "\ue001\n```\n", "code": "`\ue000", "/code": "\ue001`", "li": "- ", "/li": "\n", "br": "\n", "/p": "\n\n",
}


def html_to_text(html: Column) -> Column:
    """HTML as rough Markdown: headings, code, lists and paragraphs kept as marks, other tags gone, scripts and styles too.

    The page is cut into tags and what stands between them; every tag is looked up by its name, and the pieces are joined."""
    shown = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    pieces = F.regexp_extract_all(shown, F.lit(r"<[^<>]+>|[^<]+|<"), F.lit(0))
    marks = F.create_map(*[F.lit(x) for pair in _MARKS.items() for x in pair])
    name = lambda tag: F.lower(F.regexp_extract(tag, r"^<\s*(/?\s*\w+)", 1))
    rendered = F.transform(pieces, lambda x: F.when(x.rlike("^<[^<>]+>$"), F.coalesce(F.try_element_at(marks, name(x)), F.lit(""))).otherwise(x))
    text = F.regexp_replace(F.array_join(rendered, ""), "\ue000\\s*|\\s*\ue001", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{4,}", "\n\n\n"), r"^\s+|\s+$", "")


def without_jats(value: Column) -> Column:
    """Without opening JATS tags (closing ones stay, as callers expect)."""
    return F.regexp_replace(value, "<jats:[^>]+>", "")


def folder_name(value: Column, default: str = "untitled") -> Column:
    """A name safe for folders: forbidden signs gone, 100 characters at most, no dots or blanks around."""
    value = F.btrim(F.left(F.regexp_replace(value, r'[<>:"/\\|?*]', ""), F.lit(100)), F.lit(". "))
    return F.coalesce(F.when(value != "", value), F.lit(default))


def path_name(value: Column) -> Column:
    """Slashes and colons as underscores."""
    return F.translate(value, "/:", "__")


def identifier(value: Column) -> Column:
    """Blanks and hyphens as underscores."""
    return F.translate(value, " -", "__")


def truncated(value: Column, n: int) -> Column:
    """The first n characters, with an ellipsis if any are lost."""
    return F.when(F.length(value) > n, F.concat(F.left(value, F.lit(n)), F.lit("..."))).otherwise(value)


def seconds_of(value: Column) -> Column:
    """61.2 of '61.2s'."""
    return F.regexp_extract(value, r"([\d.]+)\s*s", 1).try_cast("double")


def duration_text(seconds: Column) -> Column:
    """Whole seconds as 1h2m3s; leading parts that are zero are left out."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60
    return (
        F.when(s.isNull(), None).when(h > 0, F.format_string("%dh%dm%ds", h, m, r)).when(m > 0, F.format_string("%dm%ds", m, r)).otherwise(F.format_string("%ds", r))
    )


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)


def stem_of(path: Column) -> Column:
    """The file name without folders and last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def keywords(value: Column, least: int = 4) -> Column:
    """Words of at least so many characters."""
    return F.filter(F.split(F.trim(value), r"\s+"), lambda w: F.length(w) >= least)


def as_int(value: Column, default: int = 0) -> Column:
    """Integers from text that may hold '2021.0' or nonsense."""
    return F.coalesce(value.try_cast("double").cast("int"), F.lit(default))


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id that is the same in every run."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\x1f", *parts), 256))


def skipped_path(path: Column, segments: tuple[str, ...], begins: tuple[str, ...], ends: tuple[str, ...]) -> Column:
    """Whether a path leads through one of the folders, or its file's name begins or ends with one of the texts."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    hit = F.arrays_overlap(parts, F.array(*map(F.lit, segments)))
    return reduce(lambda a, b: a | b, [*[name.startswith(x) for x in begins], *[name.endswith(x) for x in ends]], hit)


def language_of(path: Column, languages: dict[str, str]) -> Column:
    """The language by a path's last suffix; null if none is known."""
    named = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])
    return F.try_element_at(named, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))

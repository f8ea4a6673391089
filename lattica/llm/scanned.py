"""Repair of text from scanned pages: running headers, page numbers, divided words and misread characters.

Every text becomes its lines, one row each; what a line is follows from its shape, its neighbours (SQL windows within the
document) and its support:

* ``header``  a short line whose form with digits masked is repeated in the document, or differs from such a form by a
  glyph or two, or that reads as the beginning of the title, or that has a form (digits and names masked) that stands in
  many documents and there mostly beside a page number; with or without a page number at either end;
* ``page``    nothing but a page number in any style; plain numbers only outside a table or beside a header;
* ``hyphen``  a line whose last word goes on in the next line of running text, where the corpus knows the joined word
  better than the hyphenated one;
* ``misread`` a line of running text with a word that has the same skeleton of confusable glyphs as a far more frequent
  word; where several forms are frequent, the one more often seen after the word before is chosen.

The lexicon counts all undivided words of all texts (partial aggregation, one row a distinct word). Lines are shuffled
once, by row of the table, and their windows share that order; words are not shuffled but counted: the misread words are
a table of their own, whose written size lets Spark choose between a broadcast and a shuffle.

Defined cases: null and empty texts give no lines and stay as they are; null titles match no header; every row is a
document of its own, whether its id is null or repeated; texts without any finding stay as they are, character for
character; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import written

#: What scanned glyphs are taken for, in the order of replacement; both words of a pair get one skeleton.
#: Where pairs overlap ("ri" and "ii", "cl" and "li") no one order fits all words, so there are two.
_SINGLE = (
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
    ("@", "a"), ("!", "i"), ("0", "o"), ("(", "c"), ("5", "s"), ("1", "l"), ("|", "l"), ("6", "b"), ("9", "g"), ("$", "s"),
    ("e", "c"), ("t", "f"), ("vv", "w"), ("iii", "in"),
)
_LAST = (("ni", "in"), ("h", "b"), ("q", "g"), ("y", "v"), ("l", "i"))
GLYPHS = (
    (*_SINGLE, ("ri", "n"), ("ii", "n"), ("rn", "m"), ("cl", "d"), ("li", "h"), ("fi", "b"), ("u", "n"), *_LAST),
    (*_SINGLE, ("u", "n"), ("ii", "n"), ("li", "h"), ("fi", "b"), ("rn", "m"), ("ri", "n"), ("cl", "d"), *_LAST),
)
#: A form must be so many times as frequent as a misreading of it.
RATIO = 15
_HYPHENS = "-‐‑¬­"
_NUMBER = r"(?:\d{1,4}|[ivxlc]{1,8})"
_STYLED = rf"(?i)^(?:(?:page|pages|p\.|pg\.?|pp\.?|seite|-|–|—|\[)\s*{_NUMBER}\s*(?:of\s+\d+|/\s*\d+)?\s*[-–—\]]?|[ivxlc]{{1,8}}|\d{{1,4}}\s*(?:of|/)\s*\d{{1,4}})$"
_PLAIN = r"^\(?\d{1,4}\)?$"
_CELL = r"^[-+(]?\d[\d.,]*%?\)?$"
_CAPTION = r"^(?:(?:Table|Tab\.|Figure|Fig\.) +\d+.{0,40}|[A-Z][a-z]+ +(?:per|by) +[\w-]+:?)$"
_HEADING = r"^(?:\d+|[IVX]+)(?:\.\d+)*\.? +\p{Lu}[\p{L} -]{2,40}$"
#: A form of lines is one of headers if it stands in this share of the texts with page numbers, and in so many, and so
#: often beside a page number; the share bounds the list of forms.
FORM_SHARE, FORM_LEAST, FORM_BESIDE = 0.002, 3, 0.4


def skeleton(word: Column, order: int = 0) -> Column:
    """What is left of a lower-case word when confusable glyphs are one."""
    for seen, printed in GLYPHS[order]:
        word = F.replace(word, F.lit(seen), F.lit(printed))
    return word


def text_lines(df: DataFrame, key: str, fields: list[str], title: str | None, doc: str | None = None) -> DataFrame:
    """doc, key, field_name, title, line_no, line: the lines of all fields, from 1, blank ones included. ``doc`` names the
    row; without a column for it rows are numbered."""
    texts = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text")) for f in fields])
    return (
        df.select(
            (F.col(doc) if doc else F.monotonically_increasing_id()).alias("doc"), F.col(key).alias("key"),
            (F.col(title) if title else F.lit(None)).cast("string").alias("title"), F.inline(texts),
        )
        .where(F.col("text") != "")
        .select("doc", "key", "title", "field_name", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc", "key", "field_name", "title", (F.col("pos") + 1).alias("line_no"), "line")
    )


def _words_only(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{Nd}]+", " "))


def _bare(line: Column) -> Column:
    """The line without white space around it."""
    return F.btrim(line, F.lit(" \f\r\t"))


def _core(line: Column) -> Column:
    """The line without a page number set apart at either end."""
    return F.regexp_replace(line, r"^\s*(?:\d{1,4}|[ivxlc]+)\s{2,}|\s{2,}(?:\d{1,4}|[ivxlc]+)\s*$|^\s+|\s+$", "")


def _may_be_header(core: Column, bare: Column) -> Column:
    """Short, begins with a capital or digit, ends no sentence or clause; no heading, caption or cell."""
    return (
        F.length(core).between(6, 70) & core.rlike(r"^[\p{Lu}\d].*\p{L}.*[^.,;?]$|^\p{Lu}.* \p{Ll}{2}\.$") & ~bare.rlike(_HEADING) & ~bare.rlike(_CAPTION) & ~bare.rlike(_CELL)
    )


def _form(core: Column) -> Column:
    """The form of a line: words that hold digits and words with a capital masked, the others by their skeleton."""
    masked = F.regexp_replace(F.regexp_replace(core, r"[^\s()]*\d[^\s(),.]*", "#"), r"[^\s()#]*\p{Lu}[^\s(),.]*", "N")
    return F.regexp_replace(skeleton(masked), r"N(?: N)+", "N N")


def header_forms(df: DataFrame, fields: list[str]) -> list[str]:
    """Forms that stand in a share of the texts that have page numbers, and there mostly next to one. Neighbours are looked
    up in the text's own array of lines, so only counts are shuffled."""
    number = rf"(?:{_STYLED})|(?:{_PLAIN})"
    texts = df.select(F.explode(F.array(*[F.col(f).cast("string") for f in fields])).alias("text"))
    texts = texts.where(F.col("text").rlike(r"(?m)^[\f ]*[-–—\[(]?(?:\p{L}+\.? ?)?\d{1,4}(?: ?(?:of|/) ?\d+)?[-–—\])]?[\r ]*$"))
    lines = F.filter(F.transform(F.split("text", "\n"), _bare), lambda x: x != "")
    numbers = F.transform("lines", lambda x: (F.length(x) <= 24) & x.rlike(number))
    rows = texts.select(lines.alias("lines")).select("lines", numbers.alias("numbers"))
    rows = rows.select(F.inline(F.transform("lines", lambda x, i: F.struct(x.alias("line"), (F.get("numbers", i - 1) | F.get("numbers", i + 1)).alias("beside")))))
    rows = rows.where(_may_be_header(F.col("line"), F.col("line"))).groupBy(_form(F.col("line")).alias("form"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("beside").alias("beside")).where(F.col("n") >= FORM_LEAST)
    total = texts.agg(F.count("*")).first()[0]
    return [r.form for r in counts.where((F.col("n") >= FORM_SHARE * total) & (F.col("beside") >= FORM_BESIDE * F.col("n"))).select("form").collect()]


def classified(lines: DataFrame, forms: list[str]) -> DataFrame:
    """``doc, key, field_name, line_no, line`` with ``kind``: header, page, or (not reported) blank, table, heading, text;
    of running text the words, whether the last one is divided (``ends``), and what the next line of text is and begins with."""
    # long lines, and longer ones that go on with a small letter, are text without a closer look
    lines = lines.withColumn("bare", _bare(F.col("line")))
    lines = lines.withColumn("plain", (F.length("bare") > 90) | F.col("bare").rlike(r"^\p{Ll}.{14}"))
    lines = lines.withColumn("core", F.when(F.col("plain"), "").otherwise(_core(F.col("line"))))
    letters = F.length(F.regexp_replace("core", r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace("core", r"[^\p{Lu}]", ""))
    lines = lines.withColumns(
        {"head": F.when(~F.col("plain") & (F.length("core") <= 62), _words_only(F.col("core"))), "may": ~F.col("plain") & _may_be_header(F.col("core"), F.col("bare"))}
    )
    lines = lines.withColumn("name", F.when(F.length("head") >= 10, _words_only(F.col("title"))))
    words, title = F.col("head"), F.col("name")
    near_title = (F.length(words) >= 10) & (F.length(words) <= F.length(title)) & (
        F.startswith(title, words) | ((F.length(words) >= 14) & (F.levenshtein(words, F.substring(title, F.lit(1), F.length(words))) <= 2))
    )
    static = (
        F.when(F.col("bare") == "", "blank")
        .when(F.col("plain"), "text")
        .when(F.col("bare").rlike(_STYLED), "page")
        .when(F.col("bare").rlike(_PLAIN), "number")
        .when(F.col("bare").rlike(_CELL), "table")
        .when(F.col("bare").rlike(_CAPTION), "caption")
        .when(F.col("bare").rlike(_HEADING), "heading")
        .when(F.coalesce(near_title, F.lit(False)), "header")
        .when(F.col("may") & (letters >= 8) & (capitals >= 0.8 * letters), "header")
    )
    static = static.when(F.col("may") & _form(F.col("core")).isin(*forms), "header") if forms else static
    lines = lines.select("doc", "key", "field_name", "line_no", "line", static.otherwise("text").alias("static"), (F.col("may") & F.col("core").contains(" ")).alias("may"), "plain").repartition("doc")
    mask = F.when(~F.col("plain"), F.lower(F.regexp_replace(_core(F.col("line")), r"\d", "#")))
    lines = lines.withColumn("masked", mask)
    repeated = F.col("may") & (F.col("static") == "text") & (F.count("*").over(Window.partitionBy("doc", "masked")) >= 2)
    lines = lines.withColumn("kind", F.when(repeated, "header").otherwise(F.col("static")))
    # a line that differs by a glyph or two from a header of the same document is one too
    known = F.collect_set(F.when(F.col("kind") == "header", F.col("masked"))).over(Window.partitionBy("doc"))
    alike = F.exists(F.col("known"), lambda h: (F.abs(F.length(h) - F.length("masked")) <= 1) & (F.levenshtein(h, F.col("masked"), 2) >= 0))
    inline = F.col("line").contains("   ") & F.col("line").rlike(r"^[\f\s]*(?:(?:\d{1,4}|[ivxlc]+)\s{3,}\S.*|\S.*\S\s{3,}(?:\d{1,4}|[ivxlc]+))\s*$")
    lines = lines.withColumn("known", known).withColumn(
        "kind",
        F.when((F.col("kind") == "text") & (F.length("masked").between(8, 70)) & ((inline & (F.length("masked") <= 62)) | (alike & ~F.col("masked").rlike(r"[,;?]$"))), "header").otherwise(F.col("kind")),
    )
    order = Window.partitionBy("doc", "field_name").orderBy("line_no")
    cell = F.col("kind").isin("number", "table")
    # the last line before a run of cells says whether they are a table
    above = F.last(F.when(~cell, F.col("kind")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    filled = F.when(F.col("kind") != "blank", F.col("kind"))
    before = F.coalesce(F.lag(filled, 1).over(order), F.lag(filled, 2).over(order))
    after = F.coalesce(F.lead(filled, 1).over(order), F.lead(filled, 2).over(order))
    tables = [F.lag("kind").over(order), F.col("kind"), F.lead("kind").over(order)]
    decimals = F.array_contains(F.array(*[F.coalesce(x, F.lit("")) for x in tables]), "table")
    page = F.col("line").startswith("\f") | (F.coalesce(before, F.lit("")) == "header") | (F.coalesce(after, F.lit("")) == "header") | (
        (F.coalesce(above, F.lit("")) != "caption") & ~decimals & ~_bare(F.col("line")).startswith("(")
    )
    lines = lines.select(
        "doc", "key", "field_name", "line_no", "line",
        F.when((F.col("kind") == "number") & page, "page").when(cell | (F.col("kind") == "caption"), "table").otherwise(F.col("kind")).alias("kind"),
    )
    # words of running text, in order; the next line of running text may go on with the last one
    lines = lines.withColumn("bare", F.when(F.col("kind") == "text", _bare(F.col("line"))))
    tail = F.substring_index("bare", " ", -1)
    step = "over (partition by doc, field_name order by line_no)"
    lines = lines.withColumns(
        {
            "hyphen": tail.rlike(f"[{_HYPHENS}]$") & (F.length(tail) > 1),
            "next_line": F.expr(f"lead(case when kind = 'text' then line_no end) ignore nulls {step}"),
            "next_word": F.expr(f"lead(substring_index(bare, ' ', 1)) ignore nulls {step}"),
        }
    )
    lines = lines.withColumn("follows", F.coalesce(F.expr(f"lag(hyphen) ignore nulls {step}"), F.lit(False)))
    ends = F.coalesce(F.col("hyphen") & F.col("next_line").isNotNull(), F.lit(False))
    return lines.select(
        "doc", "key", "field_name", "line_no", "line", "kind", (F.col("follows") & (F.col("kind") == "text")).alias("follows"), ends.alias("ends"),
        F.when(ends, F.col("next_line")).alias("next_line"), F.when(ends, F.col("next_word")).alias("next_word"),
    )


def _split(line: Column) -> Column:
    """The words of a line; the cheap split by one blank where no two stand together."""
    line = _bare(line)
    return F.when(line.contains("  ") | line.contains("\t"), F.split(line, r"\s+")).otherwise(F.split(line, " "))


def _clean(word: Column) -> Column:
    """In lower case, without the signs around it."""
    return F.ltrim(F.rtrim(F.lower(word), F.lit("\"'“”‘’]}.,;:?)")), F.lit("\"'“”‘’[{.,;:"))


def lexicon(text: DataFrame) -> DataFrame:
    """word, n of all undivided words."""
    whole = F.slice(
        "words", F.when(F.col("follows"), 2).otherwise(1),
        F.greatest(F.size("words") - F.col("follows").cast("int") - F.col("ends").cast("int"), F.lit(0)),
    )
    rows = text.select(_split(F.col("line")).alias("words"), "follows", "ends")
    return rows.select(F.explode(whole).alias("w")).select(_clean(F.col("w")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def _put(raw: Column, word: Column, form: Column) -> Column:
    """The form in the word's place; a capital at the beginning stays one."""
    new = F.replace(F.lower(raw), word, form)
    return F.when(raw.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(new, 1, 1)), new.substr(F.lit(2), F.length(new)))).otherwise(new)


class Findings:
    """The parts of a repair: classified lines, divided words, misread words with the forms meant."""

    def __init__(
        self, df: DataFrame, key: str = "document_id", fields: tuple[str, ...] = ("body", "abstract"), title: str | None = "title", doc: str | None = None
    ):
        self.lines = written(classified(text_lines(df, key, list(fields), title, doc), header_forms(df, list(fields))), "lines")
        self.text = self.lines.where("kind = 'text'")
        words = written(lexicon(self.text), "lexicon")
        self.divided = written(self._divided(words), "divided")
        self.forms = written(self._forms(words, self.divided), "forms")
        self.misread = written(self._misread(), "misread")

    def _divided(self, words: DataFrame) -> DataFrame:
        """Every line end with a hyphen: its parts, and whether the hyphen is the line's only."""
        last = F.regexp_extract("line", r"(\S+)\s*$", 1)
        parts = self.text.where("ends").withColumn("last", last).select(
            "doc", "key", "field_name", "line_no", "next_line",
            F.regexp_replace(F.lower("last"), rf"[{_HYPHENS}]$|^[\"'“‘\[]+", "").alias("a"), _clean(F.col("next_word")).alias("b"),
            F.regexp_replace("last", rf"[{_HYPHENS}]$", "").alias("raw_a"), F.col("next_word").alias("raw_b"), F.col("last").rlike("[¬­]$").alias("soft"),
        )
        pairs = parts.select("a", "b").distinct()
        best = words.groupBy(skeleton(F.col("word")).alias("skel")).agg(F.max("n").alias("n"))
        known = lambda form, name: (
            pairs.select("a", "b", skeleton(form).alias("skel")).join(best, "skel", "left").select("a", "b", F.coalesce("n", F.lit(0)).alias(name))
        )
        joined, kept = known(F.concat("a", "b"), "joined"), known(F.concat_ws("-", "a", "b"), "kept")
        halves = (
            pairs.join(words.select(F.col("word").alias("a"), F.col("n").alias("n_a")), "a", "left")
            .join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b", "left")
            .select("a", "b", F.least(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))).alias("apart"))
        )
        case = (F.col("joined") > F.col("kept")) | ((F.col("joined") == F.col("kept")) & (F.col("soft") | (F.col("apart") == 0)))
        return (
            parts.join(joined, ["a", "b"]).join(kept, ["a", "b"]).join(halves, ["a", "b"])
            .select("doc", "key", "field_name", "line_no", "next_line", "a", "b", "raw_a", "raw_b", case.alias("is_case"))
        )

    @staticmethod
    def _forms(words: DataFrame, divided: DataFrame) -> DataFrame:
        """word -> the frequent forms with its skeleton, of each word that is likely a misreading; most have one."""
        joined = divided.select(F.when(F.col("is_case"), F.concat("a", "b")).otherwise(F.concat_ws("-", "a", "b")).alias("word")).distinct()
        every = words.unionByName(joined.withColumn("n", F.lit(0).cast("long"))).groupBy("word").agg(F.max("n").alias("n"))
        skeletons = F.array_distinct(F.array(*[F.concat(F.lit(str(k)), skeleton(F.col("word"), k)) for k in range(len(GLYPHS))]))
        every = written(every.withColumn("skel", F.explode(skeletons)), "words")
        top = every.groupBy("skel").agg(F.max("n").alias("best"))
        frequent = every.join(top, "skel").where("n * 3 >= best").select("skel", F.col("word").alias("form"), F.col("n").alias("best"))
        return (
            every.where(F.col("word").rlike(r"\p{L}|[@!(|]") & ~F.col("word").rlike(r"^[\d.,%()]+$"))
            .join(frequent, "skel")
            .where((F.col("word") != F.col("form")) & (F.col("best") >= RATIO * F.greatest(F.col("n"), F.lit(1))))
            .groupBy("word", "form")
            .agg(F.max("best").alias("best"))
        )

    def _misread(self) -> DataFrame:
        """Each misread word: its line, its place in it (-1: divided at the line's end), the word and the form meant."""
        # where several forms are meant, the one more often seen after the word before
        several = self.forms.groupBy("word").agg(F.collect_set("form").alias("forms")).where(F.size("forms") > 1)
        several = written(several.select(F.explode("forms").alias("form")).distinct(), "several")
        wanted = written(self.forms.select("word").unionByName(several.select(F.col("form").alias("word"))).distinct(), "wanted")
        at = ("doc", "field_name", "line_no")
        rows = self.text.select(*at, "follows", "ends", _split(F.col("line")).alias("words"))
        rows = rows.withColumn("size", F.size("words")).select(*at, "follows", "ends", "size", F.posexplode("words").alias("pos", "raw"))
        placed = rows.where("not (follows and pos = 0) and not (ends and pos = size - 1)").select(*at, "pos", _clean(F.col("raw")).alias("word")).join(wanted, "word")
        # only where a wanted word stands is the word before it looked up
        placed = written(placed, "placed")
        before = F.coalesce(_clean(F.get(_split(F.col("line")), F.col("pos") - 1)), F.lit("")).alias("before")
        placed = written(placed.join(self.text.select(*at, "key", "line"), list(at)).select(*at, "key", "pos", "word", before), "before")
        seen = placed.withColumnRenamed("word", "form").join(several, "form").groupBy("before", "form").agg(F.count("*").alias("seen"))
        hits = placed.join(self.forms, "word")
        found = (
            hits.join(seen, ["before", "form"], "left")
            .groupBy("doc", "key", "field_name", "line_no", "pos", "word")
            .agg(F.max_by("form", F.struct(F.coalesce("seen", F.lit(0)), "best", "form")).alias("form"))
        )
        ends = (
            self.divided.withColumn("word", F.when(F.col("is_case"), F.concat("a", "b")).otherwise(F.concat_ws("-", "a", "b")))
            .join(self.forms.groupBy("word").agg(F.max_by("form", F.struct("best", "form")).alias("form")), "word")
            .select(
                "doc", "key", "field_name", "word", "form",
                F.explode(
                    F.filter(
                        F.array(
                            F.when(~F.startswith("form", "a"), F.col("line_no")),
                            F.when(F.startswith("form", "a") | ~F.endswith("form", "b"), F.col("next_line")),
                        ),
                        lambda x: x.isNotNull(),
                    )
                ).alias("line_no"),
            )
        )
        return found.unionByName(ends.select("doc", "key", "field_name", "line_no", F.lit(-1).alias("pos"), "word", "form"))

    def cases(self) -> DataFrame:
        """key, field_name, line_no, kind of all findings, each once."""
        return (
            self.lines.where(F.col("kind").isin("header", "page")).select("key", "field_name", "line_no", "kind")
            .unionByName(self.divided.where("is_case").select("key", "field_name", "line_no", F.lit("hyphen").alias("kind")))
            .unionByName(self.misread.select("key", "field_name", "line_no", F.lit("misread").alias("kind")))
            .distinct()
        )

    def repaired(self) -> DataFrame:
        """doc, field_name, text: paragraphs in lines of their own, of the texts in which anything was found."""
        touched = (
            self.lines.where(F.col("kind").isin("header", "page")).select("doc", "field_name")
            .unionByName(self.divided.where("is_case").select("doc", "field_name")).unionByName(self.misread.select("doc", "field_name")).distinct()
        )
        fixes = self.misread.where("pos >= 0").groupBy("doc", "field_name", "line_no").agg(F.map_from_entries(F.collect_set(F.struct(F.col("pos"), F.struct("word", "form")))).alias("fixes"))
        ends = self.misread.where("pos = -1").select("word", "form").distinct()
        joins = self.divided.withColumn("word", F.when(F.col("is_case"), F.concat("a", "b")).otherwise(F.concat_ws("-", "a", "b"))).join(ends, "word", "left")
        raw = F.concat("raw_a", F.when(F.col("is_case"), "").otherwise("-"), "raw_b")
        at = joins.select("doc", "field_name", "line_no", F.when(F.col("form").isNotNull(), _put(raw, F.col("word"), F.col("form"))).otherwise(raw).alias("whole"))
        taken = joins.select("doc", "field_name", F.col("next_line").alias("line_no"), F.lit(True).alias("taken"))
        order = Window.partitionBy("doc", "field_name").orderBy("line_no")
        kept = self.lines.where(~F.col("kind").isin("header", "page")).join(touched, ["doc", "field_name"])
        # a blank line parts paragraphs, unless a page ended between two lines of one sentence
        previous = F.lag("kind").over(order)
        kept = kept.where("kind <> 'blank'").join(
            kept.where("kind = 'blank'").select("doc", "field_name", (F.col("line_no") + 1).alias("line_no"), F.lit(True).alias("gap")),
            ["doc", "field_name", "line_no"], "left",
        )
        ended = F.coalesce(F.lag("line").over(order).rlike(r"[.!?:]\s*$"), F.lit(True))
        new = (F.col("kind") != "text") | (previous != "text") | (F.col("line").rlike(r"^\s{3,}\S") & ended) | (F.col("gap").isNotNull() & ended)
        kept = kept.withColumn("paragraph", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order))
        kept = kept.join(fixes, ["doc", "field_name", "line_no"], "left").join(at, ["doc", "field_name", "line_no"], "left").join(taken, ["doc", "field_name", "line_no"], "left")
        words = _split(F.col("line"))
        fixed = F.transform(
            words,
            lambda w, i: F.when(
                F.col("fixes").isNotNull() & F.map_contains_key(F.coalesce("fixes", F.create_map().cast("map<int,struct<word:string,form:string>>")), i),
                _put(w, F.element_at("fixes", i)["word"], F.element_at("fixes", i)["form"]),
            ).otherwise(w),
        )
        fixed = F.when(F.col("whole").isNotNull(), F.concat(F.slice(fixed, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.array("whole"))).otherwise(fixed)
        fixed = F.when(F.col("taken"), F.slice(fixed, 2, F.greatest(F.size(fixed), F.lit(1)))).otherwise(fixed)
        return (
            kept.select("doc", "field_name", "paragraph", "line_no", F.array_join(fixed, " ").alias("line"))
            .groupBy("doc", "field_name", "paragraph")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("line"))
            .groupBy("doc", "field_name")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "line"))), lambda x: F.trim(x["line"])), "\n\n").alias("text"))
        )


def repaired_table(df: DataFrame, key: str = "document_id", fields: tuple[str, ...] = ("body", "abstract"), title: str = "title") -> DataFrame:
    """key, field_name, text of every document and field; texts without a finding as they were."""
    names = [F.col(c).alias(f"c{i}") for i, c in enumerate((key, title, *fields))]
    rows = written(df.select(F.monotonically_increasing_id().alias("doc"), *names), "numbered")  # a row's number must stay its own
    columns = dict(zip((f"c{i + 2}" for i in range(len(fields))), fields))
    found = Findings(rows, "c0", tuple(columns), "c1", "doc").repaired().withColumnRenamed("text", "better")
    texts = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("text")) for c in columns])
    named = F.element_at(F.create_map(*[F.lit(x) for pair in columns.items() for x in pair]), F.col("field_name"))
    return (
        rows.select("doc", F.col("c0").alias("key"), F.inline(texts))
        .join(found, ["doc", "field_name"], "left")
        .select(F.col("key").alias(key), named.alias("field_name"), F.coalesce("better", "text").alias("text"))
    )

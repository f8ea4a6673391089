"""Parsing of model responses, Markdown and logs as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases by which a model says that a text holds no triples.
NO_TRIPLES = (
    "no triples", "no relationships", "no relations", "cannot extract", "unable to find", "no factual information",
    "no verifiable information",
)

def stripped(value: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def json_cleaned(value: Column) -> Column:
    """Single-quoted parts double-quoted; no blanks inside braces, before colons and after commas; no comma before an end."""
    doubled = F.regexp_replace(F.btrim(value, F.lit(" \n\r\t")), "'([^']*)'", '"$1"')
    return F.regexp_replace(doubled, r"(?<=\{)\s+|,\s*(?=[}\]])|(?<=,)\s+|\s+(?=[}:])", "")


def json_slice(line: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    found = F.regexp_extract(line, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def _entries(text: Column) -> Column:
    """Keys and values of a JSON object in their order; null if it is none."""
    return F.map_entries(F.from_json(text, "map<string,string>", {"allowUnquotedControlChars": "true"}))


def _triple(entries: Column) -> Column:
    """Struct h, r, t of an object's entries, by any of its keys' spellings; null where one is missing or blank."""

    def value(key: str, *aliases: str) -> Column:
        # a key given twice counts as it comes last
        hits = F.filter(entries, lambda e: (e["key"] == key) | F.lower(e["key"]).isin(*aliases))
        return F.get(hits, F.size(hits) - 1)["value"]

    h, r, t = value("h", "subject"), value("r", "relation", "predicate"), value("t", "object")
    valid = reduce(lambda a, b: a & b, [F.trim(x) != "" for x in (h, r, t)])
    return F.when(valid, F.struct(h.alias("h"), r.alias("r"), t.alias("t")))


def triple_of(text: Column) -> Column:
    """Struct h, r, t of one JSON object, other spellings of the keys included; null where one is missing or blank."""
    return _triple(_entries(text))


def _in_order(entries: Column) -> Column:
    """Whether an object names the parts of a triple one after the other, with values that hold no quotes."""
    keys = F.concat(F.lit(" "), F.array_join(F.transform(entries, lambda e: e["key"]), " "), F.lit(" "))
    named = reduce(lambda a, b: a | b, [keys.contains(f" {k} ") for k in ("h r t", "subject relation object", "subject predicate object")])
    return named & ~F.exists(entries, lambda e: e["value"].rlike("[\"']"))


def response_triples(response: Column) -> Column:
    """Triples of a model's response, by tiers: objects without braces in them whose keys stand in order; each line from
    its first opening to its last closing brace; whatever stands between an opening and the next closing brace. A lower
    tier is tried only where those above found nothing."""
    present = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    parsed = lambda texts: F.transform(texts, lambda x: _entries(json_cleaned(x)))
    flat = F.regexp_extract_all(response, F.lit(r"\{[^{}]*\}"), F.lit(0))
    ordered = present(F.transform(F.filter(parsed(flat), _in_order), _triple))
    lines = present(F.transform(F.split(F.trim(response), "\n"), json_slice))
    opened = F.filter(F.split(response, r"\{"), lambda x, i: (i > 0) & x.contains("}"))
    rest = F.transform(opened, lambda x: F.concat(F.lit("{"), F.substring_index(x, "}", 1), F.lit("}")))
    by_line, by_brace = (present(F.transform(parsed(x), _triple)) for x in (lines, rest))
    found = F.when(F.size(ordered) > 0, ordered).when(F.size(by_line) > 0, by_line).otherwise(by_brace)
    return F.when(F.trim(response) != "", found).otherwise(F.array().cast("array<struct<h:string,r:string,t:string>>"))


def fence_stripped(text: Column) -> Column:
    """Without a code fence around it."""
    return F.regexp_replace(F.btrim(text, F.lit(" \n\r\t")), r"^```[a-zA-Z]*\s*\n?|\n?```\s*$", "")


def strict_triples(text: Column) -> Column:
    """Triples of JSON lines that name h, r and t; other lines are left out."""
    parsed = F.transform(F.split(fence_stripped(text), "\n"), lambda x: F.from_json(F.trim(x), "h string, r string, t string", {"allowSingleQuotes": "false"}))
    return F.filter(parsed, lambda x: (F.trim(x["h"]) != "") & (F.trim(x["r"]) != "") & (F.trim(x["t"]) != ""))


def needs_another_try(response: Column) -> Column:
    """Whether a response without triples looks like a failure rather than an answer."""
    low = F.lower(stripped(response))
    said = reduce(lambda a, b: a | b, [low.contains(p) for p in NO_TRIPLES])
    return (
        F.when(response.isNull() | (low == ""), True).when(said, False).when(F.length(low) < 50, False)
        .when(response.contains('"h"') | response.contains('"subject"'), False).otherwise(True)
    )


def entity_list(text: Column, least: int = 3, most: int = 8) -> Column:
    """Names in a response: a JSON list, else quoted strings, else bullets, else what commas part."""
    bare = fence_stripped(text)
    listed = F.from_json(bare, "array<string>")
    quoted = F.regexp_extract_all(bare, F.lit('"([^"]+)"'), F.lit(1))
    bullets = F.regexp_extract_all(bare, F.lit(r"(?m)^\s*(?:[-*•]|\d+\.)\s+(.+?)\s*$"), F.lit(1))
    commas = F.transform(F.split(bare, ","), lambda x: F.trim(x))
    names = F.when(listed.isNotNull(), listed).when(F.size(quoted) > 0, quoted).when(F.size(bullets) > 0, bullets).otherwise(commas)
    return F.slice(F.filter(names, lambda x: F.length(x) >= least), 1, most)


def answer_content(data: Column) -> Column:
    """The answer within a service's JSON, by the places where services put it."""
    paths = (
        "$.choices[0].message.content", "$.message.content", "$.response", "$.content", "$.text", "$.answer", "$.output", "$.result", "$.data",
    )
    return F.coalesce(*[F.get_json_object(data, p) for p in paths], data)


def answer_slice(text: Column) -> Column:
    """What stands between 'Answer:' and the sources."""
    return F.btrim(F.regexp_extract(text, r"(?s)Answer:(.*?)(?:\n\nSources|$)", 1), F.lit(" \n"))


def first_heading(text: Column) -> Column:
    return F.regexp_extract(text, r"(?m)^\s*#+\s*(.*?)\s*$", 1)


def sections(df: DataFrame, key: str, text: str, fallback: bool = True) -> DataFrame:
    """key, section_no, level, heading, body: Markdown parted at headings of two or more signs.

    Text before the first heading is left out; a document without headings is one section 'Full Text' of level 1, or
    none without ``fallback``. Headings without words open a section without a heading.
    """
    lines = df.select(F.col(key).alias("key"), F.posexplode(F.split(text, "\r?\n")).alias("pos", "line"))
    mark = F.regexp_extract("line", r"^\s*(#{2,})(?:\s|$)", 1)
    by_doc = Window.partitionBy("key").orderBy("pos")
    lines = lines.withColumn("level", F.length(mark)).withColumn("section_no", F.sum((F.col("level") > 0).cast("int")).over(by_doc))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    found = (
        lines.where("section_no > 0")
        .groupBy("key", "section_no")
        .agg(F.max("level").alias("level"), F.max(F.when(F.col("level") > 0, F.trim(F.regexp_replace("line", r"^\s*#+", "")))).alias("heading"), body.alias("body"))
        .select("key", F.col("section_no").cast("int").alias("section_no"), "level", "heading", F.btrim("body", F.lit(" \n")).alias("body"))
    )
    if not fallback:
        return found
    whole = (
        df.select(F.col(key).alias("key"), F.col(text).alias("body"))
        .where(~F.col("body").rlike(r"(?:^|\n)[^\S\n]*#{2,}(?:\s|$)"))
        .select("key", F.lit(1).alias("section_no"), F.lit(1).alias("level"), F.lit("Full Text").alias("heading"), F.btrim("body", F.lit(" \n")).alias("body"))
    )
    return found.unionByName(whole)


def log_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """One row for each event that a log line tells of: kind, done, total, triples, subject, seconds, and the server that
    the line names (a host, or what a call went to)."""
    c = F.col(line)
    # The shapes of lines that the extraction log holds.
    shapes = {
        "completed": (r"\[(\d+)/(\d+)\].*?(\d+)\s+triples.*?for\s+doc\s+(\S+).*?in\s+([\d.]+)s", ("done", "total", "triples", "subject", "seconds")),
        "extracted": (r"Extracted\s+(\d+)\s+triples\s+from\s+(\S+)\s+in\s+([\d.]+)s", ("triples", "subject", "seconds")),
        "failed": (r"Failed\s+to\s+extract.*from\s+(\S+).*after\s+([\d.]+)s", ("subject", "seconds")),
        "retry": (r"Regeneration attempt (\d+)/(\d+)(?: for (\S+))?", ("done", "total", "subject")),
        "retry_ok": (r"Regeneration successful on attempt (\d+)(?: for (\S+))?", ("done", "subject")),
        "retry_failed": (r"Regeneration failed completely for (\S+)", ("subject",)),
        "retry_triggered": (r"Regeneration triggered for (\S+)", ("subject",)),
        "retry_completed": (r"Regeneration completed successfully for (\S+)", ("subject",)),
        "started": (r"Processing doc(?:ument)? (\S+)", ("subject",)),
        "queried": (r"Querying model: (\S+).*for doc ", ("subject",)),
        "opened": (r"Starting extraction.*doc (\S+)", ("subject",)),
        "prompt": (r"Processing prompt (\d+)/(\d+):?\s*(\S+)?", ("done", "total", "subject")),
        "timeout": (r"Read timed out", ()),
        "malformed": (r"Failed to fix malformed response", ()),
        "fault": (
            r"(?i)ConnectionError|RequestException|HTTPError|ServerError|Connection refused|Connection reset|Network is unreachable|Name or service not known|Failed to connect|Socket error",
            (),
        ),
    }
    types = {"done": "int", "total": "int", "triples": "int", "subject": "string", "seconds": "double"}
    named = lambda pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    server = F.coalesce(named(r"host='([^']+)'"), named(r"\bto ([^:\s]+)"))
    events = []
    for kind, (pattern, names) in shapes.items():
        fields = [
            (F.regexp_extract(c, pattern, names.index(n) + 1).try_cast(t) if n in names else F.lit(None).cast(t)).alias(n) for n, t in types.items()
        ]
        events.append(F.when(c.rlike(pattern), F.struct(F.lit(kind).alias("kind"), *fields, server.alias("server"))))
    return lines.select("*", F.inline(F.filter(F.array(*events), lambda e: e.isNotNull())))

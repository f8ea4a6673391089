"""Text functions and parsers over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import parse, text
from lattica.operators.chunks import line_windows, python_api, python_chunks
from lattica.sources.tables import table


def _over(name: str, key: str, column: str, function, out: str = "value"):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, name).select(key, function(F.col(column)).alias(out))

    return query


def _responses(spark: SparkSession, folder: str) -> DataFrame:
    """Model responses rebuilt from the facts: plain, fenced, single-quoted, with other keys, or with words around."""
    p = table(spark, folder, "predication").where("subject_entity_name is not null and predicate is not null and object_entity_name is not null")
    quote = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"[\"'\\\p{Cntrl}{}\[\],:]", " "), r"(?U)\s+", " "))
    p = p.select("predication_id", *[quote(c).alias(n) for c, n in (("subject_entity_name", "h"), ("predicate", "r"), ("object_entity_name", "t"))])
    p = p.where("h <> '' and r <> '' and t <> ''")
    form = F.conv(F.substring("predication_id", -1, 1), 10, 10).cast("int") % 5
    plain = F.format_string('{"h": "%s", "r": "%s", "t": "%s"}', "h", "r", "t")
    response = (
        F.when(form == 0, plain)
        .when(form == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(form == 2, F.format_string("{'h': '%s', 'r': '%s', 't': '%s'}", "h", "r", "t"))
        .when(form == 3, F.format_string('{"subject": "%s", "predicate": "%s", "object": "%s"}', "h", "r", "t"))
        .otherwise(F.concat(F.lit("Here is the triple:\n"), F.format_string('{"t": "%s", "h": "%s", "r": "%s"}', "t", "h", "r"), F.lit("\nDone.")))
    )
    return p.select("predication_id", response.alias("response"))


_SPACES = r"[\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}\x{85}]+"


def _bare_sql(column: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace({column}, '["''\\[:cntrl:]{{}}\[\],:]', ' ', 'g'), '{_SPACES}', ' ', 'g'), ' ')"""


_RESPONSE_SQL = f"""(select predication_id, h, r, t from (select predication_id, {_bare_sql("subject_entity_name")} h, {_bare_sql("predicate")} r,
    {_bare_sql("object_entity_name")} t from predication where subject_entity_name is not null and predicate is not null
    and object_entity_name is not null) where h <> '' and r <> '' and t <> '')"""


def t01_response_triples(spark: SparkSession, folder: str) -> DataFrame:
    found = _responses(spark, folder).select("predication_id", F.inline(parse.response_triples(F.col("response"))))
    return found.select("predication_id", "h", "r", "t")


def t05_strict_triples(spark: SparkSession, folder: str) -> DataFrame:
    found = _responses(spark, folder).select("predication_id", F.inline(parse.strict_triples(F.col("response"))))
    return found.select("predication_id", "h", "r", "t")


def t05_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Facts as JSON lines with all that their texts hold, quotes and braces too: an exact round trip of what is not blank."""
    p = table(spark, folder, "predication")
    line = F.to_json(F.struct(F.col("subject_entity_name").alias("h"), F.col("predicate").alias("r"), F.col("object_entity_name").alias("t")))
    return p.select("predication_id", F.inline(parse.strict_triples(line)))


def t08_regeneration(spark: SparkSession, folder: str) -> DataFrame:
    """How many document texts, taken as responses, would call for another try."""
    return table(spark, folder, "documents").select("doc_id", parse.needs_another_try(F.col("text")).alias("retry"))


def t10_sections(spark: SparkSession, folder: str) -> DataFrame:
    return parse.sections(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def t11_first_heading(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", parse.first_heading(F.col("text")).alias("title"))


def t12_python_chunks(spark: SparkSession, folder: str) -> DataFrame:
    code = table(spark, folder, "documents").where("doc_kind = 'code_chunk'")
    return python_chunks(code, "doc_id", "text", whole=True).withColumnRenamed("key", "doc_id")


def t13_api(spark: SparkSession, folder: str) -> DataFrame:
    code = table(spark, folder, "documents").where("doc_kind = 'code_chunk'")
    return python_api(code, "doc_id", "text").withColumnRenamed("key", "doc_id")


def o10_line_windows(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").where("text is not null")
    return line_windows(texts, "doc_id", "text", 10).select(F.col("key").alias("doc_id"), "window_no", "first_line", F.length("chunk").alias("chars"))


def f08_dates(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.transform(F.split("issued", "-"), lambda x: x.cast("int"))
    return table(spark, folder, "crossref_metadata").where("issued is not null").select("mention_id", text.date_parts(parts).alias("value"))


def f09_authors(spark: SparkSession, folder: str) -> DataFrame:
    """Authors of each paper in their order, '; '-joined."""
    rows = table(spark, folder, "crossref_metadata").groupBy("paper_id").agg(
        F.array_sort(F.collect_list(F.struct("author_seq", "mention_id", "given", "family", F.col("full_name").alias("name")))).alias("a")
    )
    return rows.select("paper_id", text.authors_text(F.col("a")).alias("authors"))


def f19_durations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").where("value is not null").select("event_id", text.duration_text(F.col("value") * 60).alias("value"))


def f13_html(spark: SparkSession, folder: str) -> DataFrame:
    """Papers rendered as HTML pages and read back as text."""
    page = F.concat(F.lit("<style>x</style><h2>"), "pdf_filename", F.lit("</h2><p>Field <code>"), F.coalesce("field", F.lit("none")), F.lit("</code><br/>end</p>"))
    return table(spark, folder, "papers").where("pdf_filename is not null").select("pdf_filename", text.html_to_text(page).alias("value")).distinct()


QUERIES = {
    "f01_match_key": _over("entity", "entity_id", "entity_name", text.match_key),
    "f02_entity_norm": _over("entity", "entity_id", "entity_name", lambda c: text.entity_canonical(c, ("cmos", "mos"))),
    "f03_relation_norm": _over("predication", "predication_id", "predicate", text.relation_canonical),
    "f05_title_key": _over("citation_network_nodes", "id", "title", text.title_key),
    "f06_cleanup_chain": _over("entity", "entity_id", "entity_name", text.clean_up),
    "f08_date_parts": f08_dates,
    "f09_authors": f09_authors,
    "f11_scholar_id": _over("papers", "paper_id", "doi", text.scholar_id),
    "f12_second_token": _over("citation_network_nodes", "id", "title", text.second_token),
    "f13_html": f13_html,
    "f14_without_jats": _over("kg_document", "document_id", "abstract", text.without_jats),
    "f15_folder_name": _over("citation_network_nodes", "id", "title", text.folder_name),
    "f16_path_name": _over("papers", "paper_id", "doi", text.path_name),
    "f17_identifier": _over("entity", "entity_id", "entity_name", text.identifier),
    "f18_truncated": _over("documents", "doc_id", "text", lambda c: text.truncated(c, 1000)),
    "f19_durations": f19_durations,
    "f20_host": _over("citation_network_nodes", "id", "pdf_url", text.host_of),
    "f21_stem": _over("papers", "paper_id", "pdf_filename", text.stem_of),
    "f25_keywords": _over("kg_document", "document_id", "title", lambda c: F.array_join(text.keywords(c), "|")),
    "f26_as_int": _over("citation_network_nodes", "id", "pub_date", text.as_int),
    "t01_response_triples": t01_response_triples,
    "t02_json_cleaned": lambda s, d: _responses(s, d).select("predication_id", parse.json_cleaned(F.col("response")).alias("value")),
    "t03_json_slice": lambda s, d: _responses(s, d).select("predication_id", parse.json_slice(F.col("response")).alias("value")),
    "t05_strict_triples": t05_strict_triples,
    "t05_json_lines": t05_json_lines,
    "t08_regeneration": t08_regeneration,
    "t10_sections": t10_sections,
    "t11_first_heading": t11_first_heading,
    "t12_python_chunks": t12_python_chunks,
    "t13_api": t13_api,
    "o10_line_windows": o10_line_windows,
}

_ENTITY_WORD = """case when lower(w) in ('cmos', 'mos') then lower(w) when regexp_full_match(w, '\\p{Lu}{2,5}') then w
    when lower(w) like '%ies' then lower(w)[:-4] || 'y' when regexp_matches(lower(w), '(ches|shes|sses|xes|zes)$') then lower(w)[:-3]
    when lower(w) like '%es' then lower(w)[:-2] when lower(w) like '%s' and not regexp_matches(lower(w), '(ss|us|is)$') then lower(w)[:-2] else lower(w) end"""
_STEM = """case when p like '%ing' and length(p) > 5 then p[:-4] when (p like '%ed' or p like '%es') and length(p) > 5 then p[:-3]
    when p like '%s' and not regexp_matches(p, '(ss|us|is)$') and length(p) > 4 then p[:-2] else p end"""
_VERB = "case p " + " ".join(f"when '{a}' then '{b}'" for a, b in text.VERBS.items()) + f" else {_STEM} end"


def _cleanup_sql(column: str) -> str:
    out = column
    for pattern, new in text.CLEANUP:
        pattern = pattern.replace("'", "''").replace(r"\s+", _SPACES)
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'gi')"
    return f"case when trim({column}) = '' then {column} else {out} end"


_DOC_LINES = r"""(select doc_id, i, l, case when regexp_matches(l, '^\s*#{2,}(\s|$)') then length(regexp_extract(l, '^\s*(#{2,})', 1)) else 0 end as lvl
    from (select doc_id, unnest(ls) l, unnest(range(len(ls))) i from (select doc_id, regexp_split_to_array(text, '\r?\n') ls from documents where text is not null)))"""
_FORM = "cast(right(predication_id, 1) as int) % 5"


def _forms(gap: str) -> tuple[str, str, str]:
    """The JSON in a response of each form; ``gap``: what stands after commas."""
    plain = f"""'{{"h": "' || h || '",{gap}"r": "' || r || '",{gap}"t": "' || t || '"}}'"""
    other = f"""'{{"subject": "' || h || '",{gap}"predicate": "' || r || '",{gap}"object": "' || t || '"}}'"""
    mixed = f"""'{{"t": "' || t || '",{gap}"h": "' || h || '",{gap}"r": "' || r || '"}}'"""
    return plain, other, mixed


def _cleaned_sql() -> str:
    plain, other, mixed = _forms("")
    fenced = f"'```json' || chr(10) || {plain} || chr(10) || '```'"
    return f"select predication_id, case {_FORM} when 1 then {fenced} when 3 then {other} when 4 then 'Here is the triple:' || chr(10) || {mixed} || chr(10) || 'Done.' else {plain} end as value from {_RESPONSE_SQL}"


def _slice_sql() -> str:
    plain, other, mixed = _forms(" ")
    single = plain.replace("'", "\x00").replace('"', "''").replace("\x00", "'")
    return f"select predication_id, case {_FORM} when 2 then {single} when 3 then {other} when 4 then {mixed} else {plain} end as value from {_RESPONSE_SQL}"


ORACLE = {
    "t02_json_cleaned": _cleaned_sql(),
    "t03_json_slice": _slice_sql(),
    "t05_json_lines": "select predication_id, subject_entity_name h, predicate r, object_entity_name t from predication where trim(subject_entity_name, ' ') <> '' and trim(predicate, ' ') <> '' and trim(object_entity_name, ' ') <> ''",
    "t10_sections": rf"""with s as (select *, sum((lvl > 0)::int) over (partition by doc_id order by i) n from {_DOC_LINES})
        select doc_id, n::int section_no, max(lvl)::int "level", max(case when lvl > 0 then trim(regexp_replace(l, '^\s*#+', ''), ' ') end) heading,
            coalesce(trim(string_agg(l, chr(10) order by i) filter (where lvl = 0), ' ' || chr(10)), '') body from s where n > 0 group by doc_id, n
        union all select doc_id, 1, 1, 'Full Text', trim(text, ' ' || chr(10)) from documents where text is not null and doc_id not in (select doc_id from s where lvl > 0)""",
    "f01_match_key": r"select entity_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(regexp_replace(replace(entity_name, '…', '...'), '[\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', ' ', 'g')), '[^\x00-\x7F]', '', 'g')), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) as value from entity",
    "f02_entity_norm": f"select entity_id, case when trim(entity_name) = '' then entity_name else array_to_string(list_transform(list_filter(regexp_split_to_array(trim(entity_name), '{_SPACES}'), lambda w: w <> ''), lambda w: {_ENTITY_WORD}), ' ') end as value from entity",
    "f03_relation_norm": rf"select predication_id, case when predicate = '' then predicate else trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(lower(trim(predicate)), '[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{1680}}\x{{85}}\-]+', '_', 'g'), '_'), lambda p: {_VERB}), '_'), '_+', '_', 'g'), '_') end as value from predication",
    "f05_title_key": r"select id, trim(regexp_replace(regexp_replace(lower(regexp_replace(title, '<[^>]+>', '', 'g')), '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g')) as value from citation_network_nodes",
    "f06_cleanup_chain": f"select entity_id, {_cleanup_sql('entity_name')} as value from entity",
    "f08_date_parts": "select mention_id, issued as value from crossref_metadata where issued is not null",
    "f09_authors": "select paper_id, coalesce(string_agg(n, '; ' order by author_seq, mention_id), '') authors from (select *, case when given is not null and family is not null then given || ' ' || family else full_name end n from crossref_metadata) group by 1",
    "f11_scholar_id": "select paper_id, 'DOI:' || doi as value from papers",
    "f12_second_token": "select id, regexp_replace(string_split(title, ' ')[2], '^doi:', '') as value from citation_network_nodes",
    "f13_html": "select distinct pdf_filename, '## ' || pdf_filename || chr(10) || 'Field `' || coalesce(field, 'none') || '`' || chr(10) || 'end' as value from papers where pdf_filename is not null",
    "f14_without_jats": "select document_id, regexp_replace(abstract, '<jats:[^>]+>', '', 'g') as value from kg_document",
    "f15_folder_name": r"""select id, coalesce(nullif(trim(substr(regexp_replace(title, '[<>:"/\\|?*]', '', 'g'), 1, 100), '. '), ''), 'untitled') as value from citation_network_nodes""",
    "f16_path_name": "select paper_id, translate(doi, '/:', '__') as value from papers",
    "f17_identifier": "select entity_id, translate(entity_name, ' -', '__') as value from entity",
    "f18_truncated": "select doc_id, case when length(text) > 1000 then substr(text, 1, 1000) || '...' else text end as value from documents",
    "f19_durations": "select event_id, case when s >= 3600 then (s // 3600) || 'h' || (s % 3600 // 60) || 'm' || (s % 60) || 's' when s >= 60 then (s // 60) || 'm' || (s % 60) || 's' else s || 's' end as value from (select event_id, floor(value * 60)::bigint s from events where value is not null)",
    "f20_host": "select id, regexp_extract(pdf_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1) as value from citation_network_nodes",
    "f21_stem": r"select paper_id, regexp_replace(pdf_filename, '\.[^.]*$', '') as value from papers",
    "f25_keywords": r"select document_id, array_to_string(list_filter(regexp_split_to_array(trim(title), '\s+'), lambda w: length(w) >= 4), '|') as value from kg_document",
    "f26_as_int": "select id, coalesce(cast(trunc(try_cast(pub_date as double)) as int), 0) as value from citation_network_nodes",
    "t01_response_triples": f"select predication_id, h, r, t from {_RESPONSE_SQL}",
    "t05_strict_triples": f"select predication_id, h, r, t from {_RESPONSE_SQL} where cast(right(predication_id, 1) as int) % 5 in (0, 1, 4)",
    "t08_regeneration": rf"select doc_id, case when text is null or text = '' then true when "
    + " or ".join(f"contains(lower(text), '{p}')" for p in parse.NO_TRIPLES)
    + """ then false when length(text) < 50 then false when contains(text, '"h"') or contains(text, '"subject"') then false else true end as retry from (select doc_id, regexp_replace(text, '^"""
    + _SPACES + "|" + _SPACES + "$', '', 'g') as text from documents)",
    "o10_line_windows": r"""select doc_id, w::int window_no, (w * 10 + 1)::int first_line, length(array_to_string(ls[w * 10 + 1 : w * 10 + 10], chr(10)))::int chars
        from (select doc_id, ls, unnest(range(cast((len(ls) - 1) // 10 + 1 as bigint))) w from (select doc_id, regexp_split_to_array(text, '\r?\n') ls from documents where text is not null))""",
    "t11_first_heading": r"select doc_id, coalesce(regexp_extract(text, '(?m)^[\t\n\v\f\r ]*#+[\t\n\v\f\r ]*(.*?)[\t\n\v\f\r ]*$', 1), '') title from documents where text is not null",
}

"""Recorded responses of external services (bibliographic registries, preprint servers, code hosts) as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import authors_text, date_parts, first_date, without_jats

_DATE = "struct<`date-parts`:array<array<int>>>"
#: The part of a registry's record that is read.
REGISTRY = (
    "title array<string>, DOI string, abstract string, author array<struct<given:string,family:string,name:string>>,"
    f" `published-print` {_DATE}, `published-online` {_DATE}, created {_DATE}, publisher string, reference array<struct<DOI:string>>"
)
REPOSITORY = "full_name string, html_url string, description string, stargazers_count long, language string, topics array<string>, archived boolean"
GRAPH_PAGE = "data array<struct<citedPaper:struct<externalIds:struct<DOI:string,ArXiv:string>,title:string>,citingPaper:struct<externalIds:struct<DOI:string,ArXiv:string>,title:string>>>"
PREPRINT = "collection array<struct<doi:string,title:string,authors:string,date:string,version:string,category:string,abstract:string>>"
RICH_GRAPH = "struct<nodes:array<struct<id:string,name:string>>,edges:array<struct<source:string,relation:string,target:string>>>"


def registry_record(body: Column) -> Column:
    """title, doi, authors, date, abstract, publisher, cited of a registry's JSON (its message, or the whole)."""
    r = F.from_json(F.coalesce(F.get_json_object(body, "$.message"), body), REGISTRY)
    date = lambda name: date_parts(F.get(r[name]["date-parts"], F.lit(0)))
    cited = F.filter(F.transform(F.coalesce(r["reference"], F.array().cast("array<struct<DOI:string>>")), lambda x: F.lower(x["DOI"])), lambda d: d.isNotNull())
    return F.struct(
        F.get(r["title"], F.lit(0)).alias("title"), F.lower(r["DOI"]).alias("doi"), authors_text(r["author"]).alias("authors"),
        first_date(date("published-print"), date("published-online"), date("created")).alias("date"), without_jats(r["abstract"]).alias("abstract"),
        r["publisher"].alias("publisher"), cited.alias("cited"),
    )


def atom_entry(entry: Column) -> Column:
    """arxiv_id (without version), title, doi, pdf_url, year, published of an Atom entry."""
    at = lambda path: F.xpath_string(entry, F.lit(path))
    number = F.regexp_replace(F.regexp_extract(at("entry/id"), r"([^/]+)$", 1), r"v\d+$", "")
    published = at("entry/published")
    return F.struct(
        number.alias("arxiv_id"), F.trim(F.regexp_replace(at("entry/title"), r"\s+", " ")).alias("title"), F.nullif(at("entry/doi"), F.lit("")).alias("doi"),
        at("entry/link[@title='pdf']/@href").alias("pdf_url"), F.substring(published, 1, 4).try_cast("int").alias("year"), F.substring(published, 1, 10).alias("published"),
    )


def linked_dois(body: Column, side: str = "citedPaper") -> Column:
    """DOIs of a page of a citation graph: arXiv numbers as DOIs first, else the DOI; those without either are left out."""
    papers = F.transform(F.from_json(body, GRAPH_PAGE)["data"], lambda x: x[side]["externalIds"])
    dois = F.transform(papers, lambda x: F.lower(F.coalesce(F.concat(F.lit("10.48550/arxiv."), x["ArXiv"]), x["DOI"])))
    return F.coalesce(F.filter(dois, lambda d: d.isNotNull()), F.array().cast("array<string>"))


def doi_token(field: Column) -> Column:
    """The DOI among a field's tokens such as ``omid:br/1 doi:10.1/x``."""
    return F.lower(F.nullif(F.regexp_extract(field, r"(?:^|\s)doi:(\S+)", 1), F.lit("")))


def preprints(body: Column) -> Column:
    """Rows of a preprint server's page, with the address of the PDF."""
    address = lambda x: F.format_string("https://www.biorxiv.org/content/%sv%s.full.pdf", x["doi"], x["version"])
    return F.transform(F.from_json(body, PREPRINT)["collection"], lambda x: F.struct(x["doi"].alias("doi"), x["title"].alias("title"), x["date"].alias("date"), x["category"].alias("category"), address(x).alias("pdf_url")))


def repository(body: Column) -> Column:
    """A code host's record: what is missing gets a default."""
    r = F.from_json(body, REPOSITORY)
    return F.struct(
        r["full_name"].alias("full_name"), r["html_url"].alias("url"), F.coalesce(r["description"], F.lit("")).alias("description"),
        F.coalesce(r["stargazers_count"], F.lit(0)).alias("stars"), F.coalesce(r["language"], F.lit("")).alias("language"), F.coalesce(r["archived"], F.lit(False)).alias("archived"),
    )


def rich_graph(text: Column) -> Column:
    """nodes and edges of a graph's JSON, which may be wrapped in an array; invalid text gives an empty graph."""
    whole = F.from_json(text, RICH_GRAPH)
    wrapped = F.get(F.from_json(text, f"array<{RICH_GRAPH}>"), F.lit(0))
    graph = F.when(F.ltrim(text).startswith("["), wrapped).otherwise(whole)
    nodes, edges = RICH_GRAPH.split(",edges:")
    return F.struct(
        F.coalesce(graph["nodes"], F.array().cast(nodes.removeprefix("struct<nodes:"))).alias("nodes"), F.coalesce(graph["edges"], F.array().cast(edges[:-1])).alias("edges")
    )


def graph_triples(df: DataFrame, key: str, graph: str) -> DataFrame:
    """``key, h, r, t`` of the edges of rich graphs; ends are named by their nodes, or by themselves where no node is."""
    rows = df.select(key, F.col(f"{graph}.nodes").alias("__nodes"), F.inline(f"{graph}.edges"))
    # a node given twice counts as it comes last
    name = lambda c: F.coalesce(F.get(F.reverse(F.filter("__nodes", lambda n: n["id"] == F.col(c))), F.lit(0))["name"], F.col(c))
    return rows.select(key, name("source").alias("h"), F.col("relation").alias("r"), name("target").alias("t"))

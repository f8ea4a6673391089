"""Growing tables, recorded responses, work lists and predicates over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text
from lattica.operators import dedupe, evaluation, graph, merging, triples, vector
from lattica.plans.graph_queries import _LABELS, _LOOPLESS, _NODES, FIELD_ORDER, edges, facts, membership, nodes
from lattica.sources import records
from lattica.sources.tables import table

CUT = "2023-06-01"


def _cut():
    return F.lit(CUT).cast("timestamp_ntz")


def k01_upsert(spark, folder):
    """Entities of the first runs as they are, then what later runs brought under ids that are not there."""
    e = table(spark, folder, "entity").where("created_at is not null")
    old, new = e.where(F.col("created_at") < _cut()), e
    return merging.upserted(old, new, "entity_id", ["created_at", "entity_name"], ["entity_id", "entity_name", "created_at"])


def u04_triples(spark, folder):
    return dedupe.keep_first(facts(spark, folder), ["h", "r", "t"], ["predication_id"], ["predication_id", "h", "r", "t"])


def j22_pdf_doi(spark, folder):
    """The DOI of each file, as last processed."""
    return merging.last_of(table(spark, folder, "papers"), "pdf_filename", ["processed_at", "doi", "title"], ["pdf_filename", "doi"])


def j24_resume(spark, folder):
    """Papers' titles and figure counts; those of the processed run where there is one."""
    p = table(spark, folder, "papers").where("paper_id is not null")
    order = ["processed_at", "title", "doi"]
    first = dedupe.keep_first(p, ["paper_id"], order, ["paper_id", "title", "figure_count"])
    done = merging.last_of(p.where("marker_processed"), "paper_id", order, ["paper_id", "title", "figure_count", "marker_processed"])
    return merging.resumed(first, done, "paper_id", "marker_processed", ["title", "figure_count"])


def j28_backfill(spark, folder):
    """DOIs of papers and of nodes without a paper, less those with sections, only with an address to fetch from."""
    p, n = table(spark, folder, "papers").where("doi is not null"), nodes(spark, folder, "doi", "pdf_url").where("doi is not null")
    rows = merging.backfilled(p.select("doi").distinct(), n.select("doi").distinct(), "doi", p.where(F.size("sections") > 0), n.where("pdf_url is not null"))
    return rows.select("doi")


def _ids(spark, folder) -> DataFrame:
    """The least node of each DOI."""
    return nodes(spark, folder, "id", "doi").where("doi is not null").groupBy(F.lower("doi").alias("doi")).agg(F.min("id").alias("id"))


def _reference_lists(spark, folder) -> DataFrame:
    """``doi, cited`` of each node with a DOI, as a registry's JSON and read back from it."""
    n = nodes(spark, folder, "id", "doi").where("doi is not null")
    end = lambda k, name: n.select(F.col("id").alias(k), F.col("doi").alias(name))
    pairs = edges(spark, folder).select("source", "target").distinct().join(end("source", "doi"), "source").join(end("target", "cited"), "target")
    lists = pairs.groupBy("doi").agg(F.collect_list(F.struct(F.col("cited").alias("DOI"))).alias("reference"))
    body = F.to_json(F.struct(F.struct(F.col("doi").alias("DOI"), "reference").alias("message")))
    return lists.select(records.registry_record(body).alias("r")).select("r.doi", "r.cited")


def j06_cross_field(spark, folder):
    """Citations between fields, found in reference lists."""
    found = merging.cited_edges(_reference_lists(spark, folder), _ids(spark, folder))
    return merging.across(found, nodes(spark, folder, "id", "field").where("field is not null")).select("source", "target", "source_field", "target_field")


def _global(spark, folder) -> DataFrame:
    return graph.unified(nodes(spark, folder, "id", "field"), FIELD_ORDER, "field", "id")


def g20_combined(spark, folder):
    """Edges within fields and those found between them, in global ids, each once."""
    ids = _global(spark, folder)
    end = lambda k: ids.select(F.col("local_id").alias(k), F.col("global_id").alias(f"global_{k}"))
    known = nodes(spark, folder, "id", "field").where("field is not null")
    side = lambda k: known.select(F.col("id").alias(k), F.col("field").alias(f"f_{k}"))
    intra = graph.without_loops(edges(spark, folder), "source", "target").select(F.col("src").alias("source"), F.col("dst").alias("target"))
    intra = intra.join(side("source"), "source").join(side("target"), "target").where("f_source = f_target").select("source", "target")
    every = intra.unionByName(j06_cross_field(spark, folder).select("source", "target"))
    return every.join(end("source"), "source").join(end("target"), "target").select("global_source", "global_target").distinct()


def g21_new_edges(spark, folder):
    """Edges of nodes added since a day, in both directions, that the older table lacks."""
    known = nodes(spark, folder, "id", "added_at", "doi")
    old = edges(spark, folder).where(F.col("recorded_at") < _cut())
    found = merging.cited_edges(_reference_lists(spark, folder), _ids(spark, folder))
    return merging.with_new_nodes(old, found, known.where(F.col("added_at") >= _cut()))


def j14_new_dois(spark, folder):
    c = table(spark, folder, "crossref_metadata").where("doi is not null").select(F.lower("doi").alias("doi")).distinct()
    return c.join(nodes(spark, folder, "doi").select(F.lower("doi").alias("doi")), "doi", "left_anti")


def j02_metadata(spark, folder):
    """Nodes with all authors that depositors named under their DOI."""
    c = table(spark, folder, "crossref_metadata").select("doi", "mention_id", "full_name")
    return nodes(spark, folder, "id", "doi").join(c, "doi", "left").select("id", "mention_id", "full_name")


def j03_reindexed(spark, folder):
    """Papers with the new number of their node."""
    ids, _ = graph.reindexed(nodes(spark, folder, "id"), edges(spark, folder).select("source", "target").limit(0), "id", "source", "target")
    by_doi = _ids(spark, folder).join(ids, F.col("id") == F.col("old_id")).select("doi", "new_id")
    papers = dedupe.keep_first(table(spark, folder, "papers"), ["paper_id"], ["processed_at", "title", "doi"], ["paper_id", "doi"])
    return papers.select("paper_id", F.lower("doi").alias("doi")).join(by_doi, "doi", "left").select("paper_id", "new_id")


def j18_titles(spark, folder):
    """Papers without a DOI with the last added node of the same title."""
    p = table(spark, folder, "papers").where("doi is null and title is not null").select("paper_id", "title").distinct()
    n = table(spark, folder, "citation_network_nodes").where("id is not null").select("id", "title", "added_at")
    key = text.title_key(F.col("title"))
    return merging.matched_titles(p, n, key, key, ["added_at", "id"], "id").select("paper_id", "title", "id")


def j21_rename_plan(spark, folder):
    """Nodes and files by DOI: which file gets which name, which node has no file, which file no node."""
    files = merging.last_of(table(spark, folder, "papers").where("doi is not null"), "doi", ["processed_at", "pdf_filename"], ["doi", "pdf_filename"])
    return files.select(F.lower("doi").alias("doi"), "pdf_filename").groupBy("doi").agg(F.max("pdf_filename").alias("pdf_filename")).join(_ids(spark, folder), "doi", "full").select(
        "doi", "id", "pdf_filename",
        F.when(F.col("id").isNotNull() & F.col("pdf_filename").isNotNull(), F.format_string("cp '%s' '%s.pdf'", "pdf_filename", F.col("id").cast("string"))).alias("command"),
    )


#: Which server answers for which model.
SERVERS = {"lumen-8b": "alpha", "lumen-70b": "beta", "quartz-7b": "beta"}


def j25_servers(spark, folder):
    """Facts of each server, by the models that it runs; models of no server are unknown."""
    listed = spark.createDataFrame(list(SERVERS.items()), "model string, server string")
    return facts(spark, folder).groupBy("model").agg(F.count("*").alias("n")).join(F.broadcast(listed), "model", "left").groupBy(F.coalesce("server", F.lit("unknown")).alias("server")).agg(F.sum("n").alias("n"))


def j26_folders(spark, folder):
    """Of each file's two possible folders the first that exists."""
    p = table(spark, folder, "papers").where("pdf_filename is not null")
    stem = text.stem_of(F.col("pdf_filename"))
    asked = p.select("pdf_filename", F.array(F.concat(F.lit("figures/"), stem, F.lit("_v2")), F.concat(F.lit("figures/"), stem)).alias("names")).distinct()
    return merging.first_existing(asked, "pdf_filename", "names", p.select(F.col("figures_folder").alias("found")), "found")


def j29_dois_of_ids(spark, folder):
    """The DOIs of the most cited nodes, in their order."""
    top = edges(spark, folder).where("target is not null").groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(20)
    return top.join(nodes(spark, folder, "id", "doi"), F.col("target") == F.col("id")).where("doi is not null").select("target", "n", "doi")


def j30_titles(spark, folder):
    """Nodes with the paper's title where a paper has their DOI, else their own."""
    p = table(spark, folder, "papers").where("doi is not null and title is not null").groupBy("doi").agg(F.min("title").alias("paper_title"))
    return nodes(spark, folder, "id", "doi", "title").join(p, "doi", "left").select("id", F.coalesce("paper_title", "title").alias("title"))


def a07_cluster_counts(spark, folder):
    cited = edges(spark, folder).where("target is not null").groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n"))
    p = table(spark, folder, "papers").where("marker_processed and doi is not null").select(F.lower("doi").alias("doi")).distinct()
    marked = nodes(spark, folder, "id", "doi").select(F.col("id").alias("node"), F.lower("doi").alias("doi")).join(p, "doi", "left_semi")
    return merging.cluster_counts(membership(spark, folder), cited, marked, "category")


def a09_overlap(spark, folder):
    low = lambda df: df.select(F.lower("doi").alias("doi"))
    return merging.overlap(low(table(spark, folder, "papers")), low(table(spark, folder, "citation_network_nodes")), "doi")


WANTED = ["purchase", "error", "click", "absent"]


def a11_ordered(spark, folder):
    means = evaluation.variant_means(table(spark, folder, "events"), "event_type", ["value"])
    return merging.in_order_of(means, "event_type", WANTED).select("position", "event_type", F.round("avg_value", 6).alias("avg_value"))


def a14_agreement(spark, folder):
    """Mean similarity of each two labels over the groups of ten vectors that hold both."""
    runs = table(spark, folder, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("q"), F.col("label").alias("v"), F.col("embedding").alias("x"))
    return evaluation.agreement(runs, "q", "v", "x", vector.cosine).select("first", "second", F.round("similarity", 6).alias("similarity"))


def v04_pairwise(spark, folder):
    """Cosine of each two vectors within groups of ten."""
    e = table(spark, folder, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("q"), "vec_id", "embedding")
    a, b = e.select("q", F.col("vec_id").alias("first"), F.col("embedding").alias("x")), e.select("q", F.col("vec_id").alias("second"), F.col("embedding").alias("y"))
    return a.join(b, "q").where("first < second").select("first", "second", F.round(vector.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


def v02_mapping(spark, folder):
    """Ordinals of the vectors that are there."""
    return dedupe.dense_ids(table(spark, folder, "embeddings").where("embedding is not null").select("vec_id"), ["vec_id"], "ordinal").select("vec_id", "ordinal")


def a17_ratios(spark, folder):
    """Shares over all models: facts with a prompt, documents that a second model read, these with more facts then."""
    p = table(spark, folder, "predication").where("model_name is not null")
    each = p.groupBy("document_id").agg(F.count("*").alias("n"), F.count("prompt_filename").alias("ok"), F.count_distinct("model_name").alias("models"))
    return each.agg(
        F.round(F.sum("ok") / F.sum("n") * 100, 6).alias("success_pct"), F.round(F.avg((F.col("models") > 1).cast("int")) * 100, 6).alias("again_pct"),
        F.round(F.sum(F.when(F.col("models") > 1, F.col("ok"))) / F.sum(F.when(F.col("models") > 1, F.col("n"))) * 100, 6).alias("again_success_pct"),
    )


def g05_deleted(spark, folder):
    """Entities that small clusters took with them: ends of facts left out when types of fewer than 500 entities go."""
    e = table(spark, folder, "entity").where("entity_name is not null")
    large = e.groupBy("entity_type").agg(F.count("*").alias("n")).where("n >= 500").select("entity_type")
    return e.select("entity_name").subtract(e.join(large, "entity_type", "left_semi").select("entity_name")).orderBy("entity_name")


def g22_node_list(spark, folder):
    """Nodes numbered by the order in which citing and cited DOIs come, and the edges in these numbers."""
    n = nodes(spark, folder, "id", "doi").where("doi is not null")
    end = lambda k, name: n.select(F.col("id").alias(k), F.col("doi").alias(name))
    pairs = edges(spark, folder).where("recorded_at is not null").join(end("source", "a"), "source").join(end("target", "b"), "target").select("a", "b", "recorded_at")
    listed = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("doi"), "recorded_at"), F.struct(F.col("b").alias("doi"), "recorded_at"))))
    numbers = dedupe.ordinals(listed, "doi", "recorded_at")
    of = lambda k, name: numbers.select(F.col("doi").alias(k), F.col("ordinal").alias(name))
    return pairs.select("a", "b").distinct().join(of("a", "source"), "a").join(of("b", "target"), "b").select("source", "target")


#: Shapes of titles that are no titles.
MALFORMED = (r"(?:pdf|html)?\W*", r"untitled.*", r".*\.(?:pdf|docx?|tex)", r"(?:page|vol\.?) \d+.*", r"ARTICLE .*", r"\[?(?:PDF|HTML)\]? .*", r".*(?:\.\.\.|…)")


def pr07_malformed(spark, folder):
    """Titles that match one of the shapes as a whole."""
    whole = "^(?:" + "|".join(MALFORMED) + ")$"
    return table(spark, folder, "citation_network_nodes").where(F.col("title").rlike("(?s)" + whole)).select("id", "title").distinct()


def pr10_nan(spark, folder):
    """Facts with both ends named; exactly 'nan' is no name."""
    return facts(spark, folder).where("h is not null and t is not null and h <> 'nan' and t <> 'nan'").select("predication_id")


def _paths(spark, folder) -> DataFrame:
    p = table(spark, folder, "papers").where("pdf_filename is not null and field is not null")
    return p.select(F.concat_ws("/", "field", F.when(F.col("paper_id") % 5 == 0, "tests"), F.concat(F.when(F.col("paper_id") % 7 == 0, "setup_").otherwise(""), "pdf_filename")).alias("path")).distinct()


def pr13_paths(spark, folder):
    return _paths(spark, folder).where(~text.skipped_path(F.col("path"), ("tests", "build"), ("conftest", "setup"), ("_test.py", "_tests.py")))


def pr15_languages(spark, folder):
    return _paths(spark, folder).select("path", text.language_of(F.col("path"), {"pdf": "document", "py": "python"}).alias("language")).where("language is not null")


def pr14_sizes(spark, folder):
    """Texts that are not blank and hold at most 51,200 bytes."""
    return table(spark, folder, "documents").where((F.octet_length("text") <= 51200) & (F.trim("text") != "")).select("doc_id")


def pr17_failed(spark, folder):
    """Files of runs that were not processed or gave no sections, of which another run is there."""
    p = table(spark, folder, "papers").where("pdf_filename is not null")
    failed = p.where(~F.coalesce("marker_processed", F.lit(False)) | (F.coalesce(F.size("sections"), F.lit(0)) <= 0)).select("pdf_filename").distinct()
    return failed.join(p.where("marker_processed").select("pdf_filename"), "pdf_filename", "left_semi")


def t06_rich_graph(spark, folder):
    """Facts written as small graphs in JSON, a third of them in an array, some cut short; read back as triples."""
    p = table(spark, folder, "predication").where("subject_entity_id is not null and object_entity_id is not null and predicate is not null")
    node = lambda side: F.struct(F.col(f"{side}_entity_id").alias("id"), F.col(f"{side}_entity_name").alias("name"))
    whole = F.to_json(
        F.struct(
            F.array(node("subject"), node("object")).alias("nodes"),
            F.array(F.struct(F.col("subject_entity_id").alias("source"), F.col("predicate").alias("relation"), F.col("object_entity_id").alias("target"))).alias("edges"),
        )
    )
    kind = F.conv(F.substring("predication_id", -1, 1), 10, 10).cast("int")
    body = F.when(kind == 9, F.substring(whole, F.lit(1), F.length(whole) - 3)).when(kind % 3 == 0, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole)
    graphs = p.where("subject_entity_id <> object_entity_id").select("predication_id", records.rich_graph(body).alias("g"))
    return records.graph_triples(graphs, "predication_id", "g").select("predication_id", "h", "r", "t")


def s21_registry(spark, folder):
    """Depositors' rows written as a registry's records and read back."""
    c = table(spark, folder, "crossref_metadata")
    part = F.struct(F.array(F.transform(F.split("issued", "-"), lambda x: x.cast("int"))).alias("date-parts"))
    body = F.to_json(
        F.struct(
            F.struct(
                F.array("full_name").alias("title"), F.col("doi").alias("DOI"), F.concat(F.lit("<jats:p>"), "affiliation").alias("abstract"), "publisher",
                F.array(F.struct("given", "family", F.col("full_name").alias("name"))).alias("author"), F.when(F.col("issued").isNotNull(), part).alias("published-online"),
            ).alias("message")
        )
    )
    return c.select("mention_id", records.registry_record(body).alias("r")).select("mention_id", "r.title", "r.doi", "r.authors", "r.date", "r.abstract", "r.publisher")


def s24_atom(spark, folder):
    """Nodes written as Atom entries and read back."""
    n = nodes(spark, folder, "id", "pub_date").where("pub_date is not null")
    entry = F.format_string(
        "<entry><id>http://arxiv.org/abs/%s.%sv2</id><published>%sT00:00:00Z</published><title>A\n  title %s</title><link title='pdf' href='http://arxiv.org/pdf/%s'/></entry>",
        F.substring("pub_date", 1, 4), F.col("id").cast("string"), "pub_date", F.col("id").cast("string"), F.col("id").cast("string"),
    )
    return n.select("id", records.atom_entry(entry).alias("r")).select("id", "r.arxiv_id", "r.title", "r.doi", "r.pdf_url", "r.year", "r.published")


def s20_linked(spark, folder):
    """Pages of a citation graph, one for each citing node, read as DOIs."""
    n = nodes(spark, folder, "id", "doi")
    pairs = edges(spark, folder).select("source", "target").distinct().join(n.withColumnRenamed("id", "target"), "target")
    ids = F.struct(F.when(F.col("target") % 4 > 0, F.col("doi")).alias("DOI"), F.when(F.col("target") % 4 == 0, F.col("target").cast("string")).alias("ArXiv"))
    pages = pairs.where("source is not null").groupBy("source").agg(F.to_json(F.struct(F.collect_list(F.struct(F.struct(ids.alias("externalIds")).alias("citedPaper"))).alias("data"))).alias("body"))
    return pages.select("source", F.explode(records.linked_dois(F.col("body"))).alias("doi")).distinct()


def s18_tokens(spark, folder):
    n = nodes(spark, folder, "id", "doi").where("doi is not null")
    field = F.concat(F.lit("omid:br/"), F.col("id").cast("string"), F.lit(" doi:"), F.regexp_replace("doi", r"\s", ""), F.lit(" openalex:W1"))
    return n.select("id", records.doi_token(field).alias("doi"))


def s25_preprints(spark, folder):
    n = nodes(spark, folder, "id", "doi", "title", "category").where("doi is not null")
    body = F.to_json(F.struct(F.array(F.struct("doi", "title", F.lit("2020-01-01").alias("date"), F.lit("2").alias("version"), "category")).alias("collection")))
    return n.select("id", F.inline(records.preprints(body))).select("id", "doi", "category", "pdf_url")


def s26_repositories(spark, folder):
    """Depositors by publisher as a code host's records: the ten with most stars."""
    c = table(spark, folder, "crossref_metadata").where("publisher is not null").groupBy("publisher").agg(F.count("*").alias("stargazers_count"))
    body = F.to_json(F.struct(F.col("publisher").alias("full_name"), "stargazers_count"))
    return c.select(records.repository(body).alias("r")).select("r.full_name", "r.stars", "r.language", "r.archived").orderBy(F.desc("stars"), "full_name").limit(10)


def o11_batches(spark, folder):
    """Entity names numbered and dealt to batches of 32, from the tenth batch on."""
    names = table(spark, folder, "entity").where("entity_id is not null").select("entity_id").distinct()
    return dedupe.dense_ids(names, ["entity_id"], "ordinal").withColumn("batch", F.floor(F.col("ordinal") / 32).cast("long")).where("batch >= 10").select("entity_id", "batch")


def m08_work_list(spark, folder):
    """Documents, models and prompts that have no facts yet."""
    p = table(spark, folder, "predication").where("model_name is not null and prompt_filename is not null").select("document_id", "model_name", "prompt_filename")
    return merging.work_list(table(spark, folder, "kg_document"), "document_id", p.select("model_name", "prompt_filename"), p)


def c12_next(spark, folder):
    """The first document, in order, without facts of a model."""
    done = facts(spark, folder).where("model = 'lumen-8b'").select("document_id").distinct()
    return table(spark, folder, "kg_document").join(done, "document_id", "left_anti").agg(F.min("document_id").alias("document_id"))


def m02_attempts(spark, folder):
    """Of each document's readings by a model, in time, the first with a prompt."""
    p = table(spark, folder, "predication").where("model_name is not null and extracted_at is not null")
    return merging.attempt_with_result(p, ["document_id", "model_name"], ["extracted_at", "predication_id"], F.col("prompt_filename").isNotNull(), ["prompt_filename"])


def f23_stable(spark, folder):
    return table(spark, folder, "entity").where("entity_id is not null").select("entity_id", text.stable_id("e-", F.col("entity_id")).alias("value"))


def f24_defaults(spark, folder):
    n = nodes(spark, folder, "id", "category", "pub_date")
    return n.select("id", F.coalesce("category", F.lit("none")).alias("category"), F.right("pub_date", F.lit(4)).alias("tail"))


QUERIES = {
    "k01_upsert": k01_upsert, "u04_triples": u04_triples, "j02_metadata": j02_metadata, "j03_reindexed": j03_reindexed, "j06_cross_field": j06_cross_field,
    "j14_new_dois": j14_new_dois, "j18_titles": j18_titles, "j21_rename_plan": j21_rename_plan, "j22_pdf_doi": j22_pdf_doi, "j24_resume": j24_resume,
    "j25_servers": j25_servers, "j26_folders": j26_folders, "j28_backfill": j28_backfill, "j29_dois_of_ids": j29_dois_of_ids, "j30_titles": j30_titles,
    "a07_cluster_counts": a07_cluster_counts, "a09_overlap": a09_overlap, "a11_ordered": a11_ordered, "a14_agreement": a14_agreement, "a17_ratios": a17_ratios,
    "v02_mapping": v02_mapping, "v04_pairwise": v04_pairwise, "g05_deleted": g05_deleted, "g20_combined": g20_combined, "g21_new_edges": g21_new_edges,
    "g22_node_list": g22_node_list, "pr07_malformed": pr07_malformed, "pr10_nan": pr10_nan, "pr13_paths": pr13_paths, "pr14_sizes": pr14_sizes,
    "pr15_languages": pr15_languages, "pr17_failed": pr17_failed, "t06_rich_graph": t06_rich_graph, "s18_tokens": s18_tokens, "s20_linked": s20_linked,
    "s21_registry": s21_registry, "s24_atom": s24_atom, "s25_preprints": s25_preprints, "s26_repositories": s26_repositories, "o11_batches": o11_batches,
    "m02_attempts": m02_attempts, "m08_work_list": m08_work_list, "c12_next": c12_next, "f23_stable": f23_stable, "f24_defaults": f24_defaults,
    "x02_union": lambda s, d: facts(s, d).select(F.col("h").alias("entity")).union(facts(s, d).select(F.col("t").alias("entity"))).distinct(),
    "pr16_processed": lambda s, d: table(s, d, "papers").where("marker_processed").select("pdf_filename").distinct(),
}

_IDS = f"(select lower(doi) doi, min(id) id from {_NODES} where doi is not null group by 1)"
_CITED = f"""(select distinct a.id source, b.id target from citation_network_edges e join {_NODES} x on x.id = e.source join {_NODES} y on y.id = e.target
    join {_IDS} a on a.doi = lower(x.doi) join {_IDS} b on b.doi = lower(y.doi) where a.id <> b.id)"""
_CROSS = f"(select source, target, x.field source_field, y.field target_field from {_CITED} c join {_NODES} x on x.id = c.source join {_NODES} y on y.id = c.target where x.field <> y.field)"
_GLOBAL = f"(select row_number() over (order by list_position(['neuroscience', 'neuromorphic', 'aiml'], field), field, id) - 1 g, field, id from {_NODES} where field is not null)"
_PATHS = "(select distinct concat_ws('/', field, case when paper_id % 5 = 0 then 'tests' end, case when paper_id % 7 = 0 then 'setup_' else '' end || pdf_filename) path from papers where pdf_filename is not null and field is not null)"
_TITLE = r"trim(regexp_replace(regexp_replace(lower(regexp_replace(title, '<[^>]+>', '', 'g')), '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g'))"
_FIRST_PAPER = "(select * from papers where paper_id is not null qualify row_number() over (partition by paper_id order by processed_at nulls first, title nulls first, doi nulls first) = 1)"
ORACLE = {
    "k01_upsert": f"""with e as (select * from entity where created_at is not null), o as (select * from e where created_at < timestamp '{CUT}')
        select entity_id, entity_name, created_at from o union all select entity_id, entity_name, created_at from e where entity_id not in (select entity_id from o where entity_id is not null)
        qualify row_number() over (partition by entity_id order by created_at, entity_name nulls first) = 1""",
    "u04_triples": "select predication_id, subject_entity_name h, predicate r, object_entity_name t from predication qualify row_number() over (partition by h, r, t order by predication_id) = 1",
    "j02_metadata": f"select id, mention_id, full_name from {_NODES} n left join crossref_metadata c on c.doi = n.doi",
    "j03_reindexed": f"select p.paper_id, i.k new_id from (select * from papers qualify row_number() over (partition by paper_id order by processed_at nulls first, title nulls first, doi nulls first) = 1) p left join {_IDS} d on d.doi = lower(p.doi) left join (select id, row_number() over (order by id) - 1 k from {_NODES}) i on i.id = d.id",
    "j06_cross_field": f"select * from {_CROSS}",
    "j14_new_dois": f"select distinct lower(doi) doi from crossref_metadata where doi is not null and lower(doi) not in (select lower(doi) from {_NODES} where doi is not null)",
    "j18_titles": f"with n as (select {_TITLE} k, arg_max(id, coalesce(strftime(added_at, '%Y%m%d%H%M%S'), '0') || lpad(id::varchar, 20, '0')) id from citation_network_nodes where id is not null and k <> '' group by 1) select p.paper_id, p.title, n.id from (select distinct paper_id, title, {_TITLE} k from papers where doi is null and title is not null) p left join n on n.k = p.k",
    "j21_rename_plan": f"""with f as (select lower(doi) doi, max(pdf_filename) pdf_filename from (select * from papers where doi is not null qualify row_number() over (partition by doi order by processed_at desc nulls last, pdf_filename desc nulls last) = 1) group by 1)
        select coalesce(f.doi, d.doi) doi, d.id, f.pdf_filename, case when d.id is not null and f.pdf_filename is not null then 'cp ''' || f.pdf_filename || ''' ''' || d.id || '.pdf''' end command from f full join {_IDS} d on d.doi = f.doi""",
    "j22_pdf_doi": "select pdf_filename, doi from papers where pdf_filename is not null qualify row_number() over (partition by pdf_filename order by processed_at desc nulls last, doi desc nulls last, title desc nulls last) = 1",
    "j24_resume": f"""with d as (select * from papers where paper_id is not null and marker_processed qualify row_number() over (partition by paper_id order by processed_at desc nulls last, title desc nulls last, doi desc nulls last) = 1)
        select p.paper_id, case when d.paper_id is not null then d.title else p.title end title, case when d.paper_id is not null then d.figure_count else p.figure_count end figure_count from {_FIRST_PAPER} p left join d on d.paper_id = p.paper_id""",
    "j25_servers": "select case when model_name = 'lumen-8b' then 'alpha' when model_name in ('lumen-70b', 'quartz-7b') then 'beta' else 'unknown' end server, count(*) n from predication group by 1",
    "j26_folders": r"select distinct pdf_filename, f as found from (select pdf_filename, 'figures/' || regexp_replace(pdf_filename, '\.[^.]*$', '') f from papers where pdf_filename is not null) where f in (select figures_folder from papers where pdf_filename is not null)",
    "j28_backfill": f"with p as (select distinct doi from papers where doi is not null), n as (select distinct doi, pdf_url from {_NODES} where doi is not null) select distinct doi from (select doi from p union select doi from n) where doi not in (select doi from papers where doi is not null and len(sections) > 0) and doi in (select doi from n where pdf_url is not null)",
    "j29_dois_of_ids": f"select target, n, doi from (select target, count(*) n from citation_network_edges where target is not null group by 1 order by 2 desc, 1 limit 20) t join {_NODES} x on x.id = t.target where doi is not null",
    "j30_titles": f"select n.id, coalesce(p.t, n.title) title from {_NODES} n left join (select doi, min(title) t from papers where doi is not null and title is not null group by 1) p on p.doi = n.doi",
    "a07_cluster_counts": f"""with c as (select target, count(*) n from citation_network_edges where target is not null group by 1), m as (select lower(doi) d from papers where marker_processed and doi is not null)
        select l.category, count(*) as size, count(*) filter (where n >= 10) highly_cited, count(*) filter (where lower(x.doi) in (select d from m)) marked from {_LABELS} l left join c on c.target = l.node left join {_NODES} x on x.id = l.node group by 1""",
    "a09_overlap": "with p as (select distinct lower(doi) d from papers where doi is not null), n as (select distinct lower(doi) d from citation_network_nodes where doi is not null) select (select count(*) from p) left_n, (select count(*) from n) right_n, (select count(*) from (from p union from n)) either, (select count(*) from (from p intersect from n)) common",
    "a11_ordered": "select p as position, w as event_type, round(avg(value), 6) avg_value from (select unnest(range(4))::int p, unnest(['purchase', 'error', 'click', 'absent']) w) x left join events e on e.event_type = x.w group by 1, 2",
    "a14_agreement": "with e as (select vec_id // 10 q, label v, embedding::double[] x from embeddings) select a.v \"first\", b.v \"second\", round(avg(list_cosine_similarity(a.x, b.x)), 6) similarity from e a join e b on a.q = b.q and a.v < b.v group by 1, 2",
    "a17_ratios": """with d as (select document_id, count(*) n, count(prompt_filename) ok, count(distinct model_name) m from predication where model_name is not null group by 1)
        select round(sum(ok) / sum(n) * 100, 6) success_pct, round(avg((m > 1)::int) * 100, 6) again_pct, round(sum(ok) filter (where m > 1) / sum(n) filter (where m > 1) * 100, 6) again_success_pct from d""",
    "v02_mapping": "select vec_id, row_number() over (order by vec_id) - 1 ordinal from embeddings where embedding is not null",
    "v04_pairwise": "with e as (select vec_id, embedding::double[] x from embeddings) select a.vec_id \"first\", b.vec_id \"second\", round(list_cosine_similarity(a.x, b.x), 6) cosine from e a join e b on a.vec_id // 10 = b.vec_id // 10 and a.vec_id < b.vec_id",
    "g05_deleted": "with e as (select * from entity where entity_name is not null) select entity_name from e except select entity_name from e where entity_type in (select entity_type from e group by 1 having count(*) >= 500)",
    "g20_combined": f"""with x as (select source, target from {_LOOPLESS} e join {_NODES} a on a.id = e.source join {_NODES} b on b.id = e.target where a.field = b.field union select source, target from {_CROSS})
        select distinct a.g global_source, b.g global_target from x join {_GLOBAL} a on a.id = x.source join {_GLOBAL} b on b.id = x.target""",
    "g21_new_edges": f"""with w as (select id from {_NODES} where added_at >= timestamp '{CUT}') select source, target from {_CITED} c where (source in (from w) or target in (from w))
        and not exists (select 1 from citation_network_edges e where e.recorded_at < timestamp '{CUT}' and e.source = c.source and e.target = c.target)""",
    "g22_node_list": f"""with n as (select id, doi from {_NODES} where doi is not null), p as (select x.doi a, y.doi b, recorded_at t from citation_network_edges e join n x on x.id = e.source join n y on y.id = e.target where recorded_at is not null),
        o as (select doi, row_number() over (order by min(t), encode(doi)) - 1 k from (select a doi, t from p union all select b, t from p) group by doi)
        select x.k source, y.k target from (select distinct a, b from p) q join o x on x.doi = q.a join o y on y.doi = q.b""",
    "pr07_malformed": "select distinct id, title from citation_network_nodes where regexp_matches(title, '(?s)^(?:" + "|".join(MALFORMED) + ")$')",
    "pr10_nan": "select predication_id from predication where subject_entity_name is not null and object_entity_name is not null and subject_entity_name <> 'nan' and object_entity_name <> 'nan'",
    "pr13_paths": f"select path from {_PATHS} where not (list_has_any(string_split(path, '/'), ['tests', 'build']) or regexp_matches(path, '(^|/)(conftest|setup)[^/]*$') or path like '%\\_test.py' escape '\\' or path like '%\\_tests.py' escape '\\')",
    "pr14_sizes": "select doc_id from documents where octet_length(encode(text)) <= 51200 and trim(text, ' ') <> ''",
    "pr15_languages": f"select path, 'document' as language from {_PATHS} where path like '%.pdf'",
    "pr16_processed": "select distinct pdf_filename from papers where marker_processed",
    "pr17_failed": "select distinct pdf_filename from papers where pdf_filename is not null and (not coalesce(marker_processed, false) or coalesce(len(sections), 0) = 0) and pdf_filename in (select pdf_filename from papers where marker_processed and pdf_filename is not null)",
    "t06_rich_graph": """select predication_id, coalesce(subject_entity_name, subject_entity_id) h, predicate r, coalesce(object_entity_name, object_entity_id) t from predication
        where subject_entity_id is not null and object_entity_id is not null and predicate is not null and subject_entity_id <> object_entity_id and right(predication_id, 1) <> '9'""",
    "s18_tokens": rf"select id, lower(regexp_replace(doi, '\s', '', 'g')) doi from {_NODES} where doi is not null",
    "s20_linked": f"select distinct source, lower(case when target % 4 = 0 then '10.48550/arxiv.' || target else doi end) doi from citation_network_edges e join {_NODES} n on n.id = e.target where source is not null and (target % 4 = 0 or doi is not null)",
    "s21_registry": "select mention_id, full_name title, lower(doi) doi, coalesce(case when given is not null and family is not null then given || ' ' || family else full_name end, '') authors, issued as date, affiliation abstract, publisher from crossref_metadata",
    "s24_atom": f"select id, substr(pub_date, 1, 4) || '.' || id arxiv_id, 'A title ' || id title, null::varchar doi, 'http://arxiv.org/pdf/' || id pdf_url, substr(pub_date, 1, 4)::int as \"year\", substr(pub_date || 'T00:00:00Z', 1, 10) published from {_NODES} where pub_date is not null",
    "s25_preprints": f"select id, doi, category, 'https://www.biorxiv.org/content/' || doi || 'v2.full.pdf' pdf_url from {_NODES} where doi is not null",
    "s26_repositories": "select publisher full_name, count(*) stars, '' as language, false archived from crossref_metadata where publisher is not null group by 1 order by 2 desc, encode(publisher) limit 10",
    "o11_batches": "select entity_id, k // 32 batch from (select entity_id, row_number() over (order by encode(entity_id)) - 1 k from (select distinct entity_id from entity where entity_id is not null)) where k // 32 >= 10",
    "m02_attempts": """with p as (select *, row_number() over (partition by document_id, model_name order by extracted_at, predication_id) k from predication where model_name is not null and extracted_at is not null)
        select document_id, model_name, k::int attempt, prompt_filename from p where prompt_filename is not null qualify row_number() over (partition by document_id, model_name order by k) = 1""",
    "m08_work_list": """with p as (select distinct document_id, model_name, prompt_filename from predication where model_name is not null and prompt_filename is not null)
        select document_id, model_name, prompt_filename from (select distinct document_id from kg_document), (select distinct model_name, prompt_filename from p) except select * from p""",
    "c12_next": "select min(document_id) document_id from kg_document where document_id not in (select document_id from predication where model_name = 'lumen-8b' and document_id is not null)",
    "f23_stable": "select entity_id, 'e-' || sha256(entity_id) as value from entity where entity_id is not null",
    "f24_defaults": f"select id, coalesce(category, 'none') category, right(pub_date, 4) tail from {_NODES}",
    "x02_union": "select subject_entity_name entity from predication union select object_entity_name from predication",
}

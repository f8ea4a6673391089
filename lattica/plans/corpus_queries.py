"""Corpus assembly, vectors, logs and evaluation over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.parse import log_events
from lattica.operators import corpus, dedupe, evaluation, graph, lookups, vector
from lattica.plans.graph_queries import _NODES, edges, nodes
from lattica.session import new_path
from lattica.sources.tables import table
from lattica.streaming.orphan_stream import late_counts


def papers(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The columns of each paper once, a processed run first."""
    order = [F.col("marker_processed").isNull(), ~F.col("marker_processed"), "processed_at", "title", "doi"]
    return dedupe.keep_first(table(spark, folder, "papers"), ["paper_id"], order, list(columns))


def j01_papers_nodes(spark, folder):
    """Papers with the id of the node that has their DOI."""
    ids = nodes(spark, folder, "id", "doi").where("doi is not null").select(F.lower("doi").alias("d"), F.col("id").alias("node_id"))
    return papers(spark, folder, "paper_id", "doi").join(ids, F.lower("doi") == F.col("d"), "left").select("paper_id", "node_id")


def j11_not_in_other_source(spark, folder):
    """Papers whose DOI, whatever its case, no node has; papers without a DOI stay."""
    known = nodes(spark, folder, "doi").select(F.lower("doi").alias("d")).distinct()
    return papers(spark, folder, "paper_id", "doi").join(known, F.lower("doi") == F.col("d"), "left_anti").select("paper_id", "doi")


def j12_precedence_union(spark, folder):
    """One list of DOIs and titles: the papers', and those nodes' that no paper has."""
    first = papers(spark, folder, "doi", "title").where("doi is not null").groupBy("doi").agg(F.min("title").alias("title"))
    second = nodes(spark, folder, "doi", "title").where("doi is not null").groupBy("doi").agg(F.min("title").alias("title"))
    return lookups.precedence_union(first, second, ["doi"])


def j20_updated(spark, folder):
    """Papers' DOIs filled from the depositors' records."""
    deposited = table(spark, folder, "crossref_metadata").groupBy("paper_id").agg(F.min("doi").alias("doi"))
    return lookups.updated(papers(spark, folder, "paper_id", "doi"), deposited, ["paper_id"], ["doi"], overwrite=False)


def j27_both_directions(spark, folder):
    """Edges from papers of one field to another's nodes, and the other way round."""
    side = lambda f: nodes(spark, folder, "id", "field").where(F.col("field") == f).select("id")
    e = edges(spark, folder).select("source", "target").distinct()
    one = lambda a, b: e.join(side(a), e.source == F.col("id"), "left_semi").join(side(b), e.target == F.col("id"), "left_semi")
    return one("aiml", "neuroscience").withColumn("way", F.lit("out")).unionAll(one("neuroscience", "aiml").withColumn("way", F.lit("in")))


def u08_processed_first(spark, folder):
    return dedupe.processed_first(table(spark, folder, "papers"), "pdf_filename", "marker_processed", ["processed_at", "title", "doi"], ["pdf_filename", "title", "doi"]).select("pdf_filename", "title", "doi")


def s03_section_text(spark, folder):
    return papers(spark, folder, "paper_id", "sections").select("paper_id", corpus.section_text(F.col("sections")).alias("text"))


def s16_paper_text(spark, folder):
    return papers(spark, folder, "paper_id", "title", "sections").select("paper_id", corpus.paper_text(F.col("title"), F.col("sections")).alias("text"))


def k21_template(spark, folder):
    return corpus.template(nodes(spark, folder, "id", "title", "doi", "abstract")).select("pdf_filename", "title", "doi", "figures_folder", F.get("sections", F.lit(0))["section_text"].alias("first_section"))


def a24_counts(spark, folder):
    return table(spark, folder, "papers").groupBy("field").agg(
        F.count("*").alias("rows"), F.sum(F.coalesce(F.size("sections"), F.lit(0))).alias("sections"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.sum("figure_count").alias("figures"),
    )


def u10_ordinals(spark, folder):
    """Distinct DOIs numbered in the order in which nodes brought them."""
    rows = table(spark, folder, "citation_network_nodes").where("doi is not null").select("doi", "added_at")
    return dedupe.ordinals(rows, "doi", "added_at").select("doi", "ordinal")


def o07_offsets(spark, folder):
    """How many nodes come before each field's."""
    sizes = nodes(spark, folder, "field").where("field is not null").groupBy("field").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("field").rowsBetween(Window.unboundedPreceding, -1))  # one row a field
    return sizes.select("field", "n", F.coalesce(before, F.lit(0)).alias("offset"))


def _queries(spark, folder):
    """Every vector whose id is divisible by 50, against all."""
    return table(spark, folder, "embeddings").where("vec_id % 50 = 0")


def knn(metric):
    def query(spark, folder):
        found = vector.nearest(table(spark, folder, "embeddings"), _queries(spark, folder), 5, "vec_id", "embedding", metric)
        return found.select("query_id", "id", "rank", F.round(F.abs("score") if metric == "l2" else F.col("score"), 5).alias("score"))

    return query


def v04_label_cosine(spark, folder):
    """Cosine of the mean vectors of each pair of labels."""
    means = vector.mean_vectors(table(spark, folder, "embeddings"), "label", "embedding")
    a, b = means.select(F.col("group").alias("first"), F.col("mean").alias("x")), means.select(F.col("group").alias("second"), F.col("mean").alias("y"))
    return a.join(b, F.col("first") < F.col("second")).select("first", "second", F.round(vector.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


def v05_unit(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.round(vector.norm(vector.unit(F.col("embedding"))), 6).alias("length"), F.transform(F.slice(vector.unit(F.col("embedding")), 1, 4), lambda x: F.round(x, 6)).alias("begins"))


_SERVERS = "event_type"


def _log_lines(spark, folder):
    """The events written as an extraction log."""
    e = table(spark, folder, "events")
    line = (
        F.when(F.col("event_id") % 7 == 0, F.format_string("Failed to extract triples from %s after %ss", F.col(_SERVERS), F.round("value", 2).cast("string")))
        .when(F.col("event_id") % 7 == 1, F.format_string("Read timed out while calling %s", F.col(_SERVERS)))
        .otherwise(F.format_string("Extracted %s triples from %s in %ss", (F.col("user_id") % 90).cast("string"), F.col(_SERVERS), F.round("value", 2).cast("string")))
    )
    return e.where("value is not null and event_type is not null").select("event_id", "ts", line.alias("line"))


def t14_log_events(spark, folder):
    return log_events(_log_lines(spark, folder)).select("event_id", "kind", "subject", "triples", "seconds")


def a16_rollup(spark, folder):
    found = t14_log_events(spark, folder).where("kind in ('extracted', 'failed')")
    out = evaluation.rollup_by(found, "subject", F.col("kind") == "extracted", F.col("seconds"), 60.0)
    return out.select("subject", "requests", "success", "failed", "over_limit", F.round("total_s", 2).alias("total_s"), F.round("avg_s", 4).alias("avg_s"))


def a16_servers(spark, folder):
    """The events written as lines of ten kinds, each with its host, and counted by server."""
    e, host = table(spark, folder, "events").where("event_type is not null"), F.concat(F.lit(" host='"), F.col("event_type"), F.lit("'"))
    shapes = (
        "Failed to extract triples from m after 2.5s", "Read timed out.", "Failed to fix malformed response", "Connection refused", "Regeneration attempt 1/3 for m",
        "Regeneration successful on attempt 2 for m", "Regeneration triggered for m", "Processing prompt 1/2: p", "nothing", "Querying model: m for doc d",
    )
    k = F.col("event_id") % 20
    line = F.format_string("Extracted %s triples from m in 1.5s", (F.col("user_id") % 90).cast("string"))
    line = F.coalesce(*[F.when(k == i, F.lit(x)) for i, x in enumerate(shapes)], line)
    return evaluation.server_report(log_events(e.select("event_id", F.concat(line, host).alias("line"))).where("server is not null"))


def a15_time_buckets(spark, folder):
    found = t14_log_events(spark, folder).where("kind = 'extracted'")
    return found.groupBy(evaluation.time_bucket(F.col("seconds") * 10).alias("bucket")).agg(F.count("*").alias("n"))


def o08_carry_forward(spark, folder):
    """Lines that name no server get the last one named before by the same user."""
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("server"))
    return graph.carried_forward(rows, "server", ["ts", "event_id"], ["user_id"], "last_server").select("event_id", "last_server")


def a12_variant_means(spark, folder):
    out = evaluation.variant_means(table(spark, folder, "events"), "event_type", ["value"])
    return out.select("event_type", F.round("avg_value", 6).alias("avg_value"))


def a13_baseline_delta(spark, folder):
    runs = table(spark, folder, "events").withColumn("grp", F.col("user_id") % 10)
    out = evaluation.baseline_delta(runs, "grp", "event_type", "value", "click")
    return out.select("grp", "event_type", F.round("delta", 6).alias("delta"))


def a18_completion(spark, folder):
    """Of the documents times four models, how many pairs have facts, and how long the rest would take at one second a fact."""
    p = table(spark, folder, "predication").where("model_name is not null").groupBy("document_id", "model_name").agg(F.count("*").cast("double").alias("s"))
    expected = table(spark, folder, "kg_document").count() * 4
    out = evaluation.completion(p, F.lit(expected), ["document_id", "model_name"], "s")
    return out.select("done", "remaining", F.round("pct", 6).alias("pct"), F.round("eta_s", 3).alias("eta_s"))


def a20_summary(spark, folder):
    d = table(spark, folder, "kg_document")
    return d.agg(
        F.count("*").alias("documents"), F.round(F.avg(F.length("body")), 6).alias("avg_length"),
        F.round(F.avg((F.length("body") > 4000).cast("double")), 6).alias("truncated_rate"),
    )


def stream_counts(spark, folder):
    """The batch form of the windowed counts that the streaming job keeps."""
    return (
        table(spark, folder, "events").where("event_type is not null")
        .groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("day"), "event_type", "n")
    )


def stream_windows(spark, folder):
    """The same counts by a streaming job over the files, with a watermark of a day: windows that it has closed."""
    out, events = new_path(spark, "windows"), table(spark, folder, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events.parquet*").where("event_type is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = late_counts(stream, "ts", "1 day", "1 day", "event_type")
    query = counts.writeStream.option("path", out).option("checkpointLocation", new_path(spark, "stream")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(out).select(F.col("window_start").cast("timestamp_ntz").alias("day"), F.col("key").alias("event_type"), "n")


QUERIES = {
    "j01_papers_nodes": j01_papers_nodes,
    "j11_not_in_other_source": j11_not_in_other_source,
    "j12_precedence_union": j12_precedence_union,
    "j20_updated": j20_updated,
    "j27_both_directions": j27_both_directions,
    "u02_paper_dedupe": lambda s, d: papers(s, d, "paper_id", "title", "doi"),
    "u08_processed_first": u08_processed_first,
    "u10_ordinals": u10_ordinals,
    "s02_ordered_limit": lambda s, d: table(s, d, "kg_document").orderBy("document_id").limit(20).select("document_id", "title"),
    "s03_section_text": s03_section_text,
    "s05_range_slice": lambda s, d: corpus.range_slice(table(s, d, "kg_document"), "document_id", 10, 40).select("document_id"),
    "s16_paper_text": s16_paper_text,
    "s27_download_commands": lambda s, d: corpus.download_commands(nodes(s, d, "id", "pdf_url")),
    "k21_template": k21_template,
    "a23_date_range": lambda s, d: table(s, d, "citation_network_nodes").where("pub_date <> ''").agg(F.min("pub_date").alias("first"), F.max("pub_date").alias("last")),
    "a24_counts": a24_counts,
    "o07_offsets": o07_offsets,
    "pr18_new_nodes": lambda s, d: nodes(s, d, "id").join(F.broadcast(edges(s, d).agg(F.max(F.greatest("source", "target")).alias("m"))), F.col("id") > F.col("m")).select("id"),
    "v03_knn_ip": knn("ip"),
    "v03_knn_l2": knn("l2"),
    "v04_label_cosine": v04_label_cosine,
    "v05_unit": v05_unit,
    "t14_log_events": t14_log_events,
    "a16_rollup": a16_rollup,
    "a15_time_buckets": a15_time_buckets,
    "a16_servers": a16_servers,
    "o08_carry_forward": o08_carry_forward,
    "a12_variant_means": a12_variant_means,
    "a13_baseline_delta": a13_baseline_delta,
    "a18_completion": a18_completion,
    "a20_summary": a20_summary,
    "stream_counts": stream_counts,
    "stream_windows": stream_windows,
}

_PAPERS = "(select * from papers qualify row_number() over (partition by paper_id order by marker_processed is null, not marker_processed nulls first, processed_at nulls first, title nulls first, doi nulls first) = 1)"
_LOG = '''(select event_id, event_type, (user_id % 90)::int triples, round(value, 2) as "seconds", event_id % 7 k from events where value is not null and event_type is not null)'''


def _knn_sql(score: str, shown: str = "score") -> str:
    return f"""select query_id, id, rank, round({shown}, 5) score from (select q.vec_id query_id, v.vec_id id, {score} score, row_number() over (partition by q.vec_id order by {score} desc, v.vec_id) rank
        from (select vec_id, embedding::double[] e from embeddings where vec_id % 50 = 0) q, (select vec_id, embedding::double[] e from embeddings) v) where rank <= 5"""


ORACLE = {
    "j01_papers_nodes": f"select p.paper_id, n.id node_id from {_PAPERS} p left join {_NODES} n on lower(n.doi) = lower(p.doi)",
    "j11_not_in_other_source": f"select paper_id, doi from {_PAPERS} p where not exists (select 1 from {_NODES} n where lower(n.doi) = lower(p.doi))",
    "j12_precedence_union": f"with a as (select doi, min(title) title from {_PAPERS} where doi is not null group by 1), b as (select doi, min(title) title from {_NODES} where doi is not null group by 1) select * from a union all select * from b where doi not in (select doi from a)",
    "j20_updated": f"select p.paper_id, coalesce(p.doi, c.doi) doi from {_PAPERS} p left join (select paper_id, min(doi) doi from crossref_metadata group by 1) c on c.paper_id = p.paper_id",
    "j27_both_directions": f"with e as (select distinct source, target from citation_network_edges), a as (select id from {_NODES} where field = 'aiml'), b as (select id from {_NODES} where field = 'neuroscience') select *, 'out' way from e where source in (from a) and target in (from b) union all select *, 'in' from e where source in (from b) and target in (from a)",
    "u02_paper_dedupe": f"select paper_id, title, doi from {_PAPERS}",
    "u08_processed_first": """select pdf_filename, title, doi from (select *, max(coalesce(marker_processed, false)) over (partition by pdf_filename) any_done,
        row_number() over (partition by pdf_filename, coalesce(marker_processed, false) order by processed_at nulls first, title nulls first, doi nulls first) f,
        row_number() over (partition by pdf_filename, coalesce(marker_processed, false) order by processed_at desc nulls last, title desc nulls last, doi desc nulls last) l from papers)
        where pdf_filename is null or (any_done and coalesce(marker_processed, false) and f = 1) or (not any_done and l = 1)""",
    "u10_ordinals": "select doi, row_number() over (order by a, encode(doi)) - 1 ordinal from (select doi, min(added_at) a from citation_network_nodes where doi is not null group by 1)",
    "s02_ordered_limit": "select document_id, title from kg_document order by document_id limit 20",
    "s03_section_text": f"select paper_id, coalesce(array_to_string(list_transform(sections, lambda s: coalesce(s.body, '')), ' '), '') as text from {_PAPERS}",
    "s05_range_slice": "select document_id from kg_document order by document_id limit 30 offset 10",
    "s16_paper_text": f"select paper_id, array_to_string(list_filter(list_concat([nullif(trim(title, ' '), '')], flatten(list_transform(coalesce(sections, []), lambda s: [nullif(trim(s.heading, ' '), ''), nullif(trim(s.body, ' '), '')]))), lambda x: x is not null), chr(10) || chr(10)) as text from {_PAPERS}",
    "s27_download_commands": f"select id, 'wget -O ''' || id || '.pdf'' ''' || pdf_url || '''' command from {_NODES} where trim(pdf_url, ' ') <> '' and not contains(lower(pdf_url), 'unable') and not contains(lower(pdf_url), 'dropbox')",
    "k21_template": f"select id || '.pdf' pdf_filename, title, doi, 'figures/' || id figures_folder, case when trim(abstract, ' ') <> '' then abstract end first_section from {_NODES}",
    "a23_date_range": "select min(pub_date) \"first\", max(pub_date) \"last\" from citation_network_nodes where pub_date <> ''",
    "a24_counts": "select field, count(*) \"rows\", sum(coalesce(len(sections), 0))::bigint sections, count(error) errors, sum(figure_count)::bigint figures from papers group by 1",
    "o07_offsets": f"select field, n, coalesce(sum(n) over (order by field rows between unbounded preceding and 1 preceding), 0)::bigint \"offset\" from (select field, count(*) n from {_NODES} where field is not null group by 1)",
    "pr18_new_nodes": f"select id from {_NODES} where id > (select max(greatest(source, target)) from citation_network_edges)",
    "v03_knn_ip": _knn_sql("list_inner_product(q.e, v.e)"),
    "v03_knn_l2": _knn_sql("-power(list_distance(q.e, v.e), 2)", "abs(score)"),
    "v04_label_cosine": "with m as (select label, list(x order by pos) v from (select label, pos, avg(x) x from (select label, unnest(embedding::double[]) x, unnest(range(len(embedding))) pos from embeddings) group by 1, 2) group by 1) select a.label \"first\", b.label \"second\", round(list_cosine_similarity(a.v, b.v), 6) cosine from m a join m b on a.label < b.label",
    "v05_unit": "select vec_id, case when list_inner_product(embedding::double[], embedding::double[]) > 0 then 1.0::double else 0.0::double end as length, list_transform(embedding[1:4], lambda x: round(x::double / sqrt(list_inner_product(embedding::double[], embedding::double[])), 6)) begins from embeddings",
    "t14_log_events": f'''select event_id, case k when 0 then 'failed' when 1 then 'timeout' else 'extracted' end kind, case when k <> 1 then event_type end subject, case when k > 1 then triples end triples, case when k <> 1 then "seconds" end as "seconds" from {_LOG}''',
    "a16_rollup": f"select event_type subject, count(*) requests, count(*) filter (where k > 1) success, count(*) filter (where k = 0) failed, count(*) filter (where seconds > 60) over_limit, round(sum(seconds) filter (where k > 1), 2) total_s, round(avg(seconds) filter (where k > 1), 4) avg_s from {_LOG} where k <> 1 group by 1",
    "a15_time_buckets": f"select case when seconds * 10 < 60 then '<1m' when seconds * 10 < 300 then '1-5m' when seconds * 10 < 600 then '5-10m' when seconds * 10 < 3600 then '10-60m' else '>1h' end bucket, count(*) n from {_LOG} where k > 1 group by 1",
    "a16_servers": """with c as (select event_type server, count(*) filter (where k = 0 or k >= 10) requests, count(*) filter (where k >= 10) success, count(*) filter (where k = 0) failed, count(*) filter (where k = 1) timeouts,
        count(*) filter (where k = 2) malformed, count(*) filter (where k = 3) faults, count(*) filter (where k = 4) retries, count(*) filter (where k = 5) retries_ok, sum(user_id % 90) filter (where k >= 10)::bigint triples
        from (select *, event_id % 20 k from events where event_type is not null) group by 1)
        select *, round(success / nullif(requests, 0) * 100, 6) success_pct, round(retries / nullif(requests, 0) * 100, 6) retry_pct, round(retries_ok / nullif(retries, 0) * 100, 6) retry_ok_pct from c""",
    "o08_carry_forward": "select event_id, last_value(server ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) last_server from (select *, case when event_id % 3 > 0 then event_type end server from events)",
    "a12_variant_means": "select event_type, round(avg(value), 6) avg_value from events group by 1",
    "a13_baseline_delta": "with m as (select user_id % 10 grp, event_type, avg(value) v from events group by 1, 2) select a.grp, a.event_type, round(a.v - b.v, 6) delta from m a join m b on a.grp = b.grp and b.event_type = 'click' where a.event_type <> 'click'",
    "a18_completion": "with g as (select document_id, model_name, count(*) s from predication where model_name is not null group by 1, 2), e as (select count(*) * 4 x from kg_document) select count(*) done, any_value(x) - count(*) remaining, round(count(*) / any_value(x) * 100, 6) pct, round(avg(s) * (any_value(x) - count(*)), 3) eta_s from g, e",
    "a20_summary": "select count(*) documents, round(avg(length(body)), 6) avg_length, round(avg(case when length(body) > 4000 then 1.0 when body is null then null else 0.0 end), 6) truncated_rate from kg_document",
    "stream_windows": "select day, event_type, n from (select date_trunc('day', ts)::timestamp as day, event_type, count(*) n from events where event_type is not null group by 1, 2) where day + interval 1 day <= (select max(ts) - interval 1 day from events where event_type is not null)",
    "stream_counts": "select date_trunc('day', ts)::timestamp as day, event_type, count(*) n from events where event_type is not null group by 1, 2",
}

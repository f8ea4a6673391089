"""Knowledge-graph and citation-network queries over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.text import match_key
from lattica.operators import community, dedupe, graph, lookups, retrieval, steiner, triples
from lattica.plans.text_queries import _ENTITY_WORD, _SPACES, _cleanup_sql
from lattica.plans.text_queries import ORACLE as TEXT_ORACLE
from lattica.session import written
from lattica.sources.tables import table


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return triples.from_predications(table(spark, folder, "predication"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "citation_network_edges")


def nodes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The columns of each node once, as first added."""
    return dedupe.keep_first(table(spark, folder, "citation_network_nodes"), ["id"], ["added_at", "title", "doi"], list(columns))


def a03_duplicates(spark, folder):
    return dedupe.duplicates(facts(spark, folder), ["h", "r", "t"], match_key)


def u01_entity_dedupe(spark, folder):
    return dedupe.keep_first(table(spark, folder, "entity"), [match_key(F.col("entity_name"))], ["created_at", "entity_id"], ["entity_id", "entity_name"])


def u03_pred_dedupe(spark, folder):
    keys = [match_key(F.col(c)) for c in ("h", "r", "t")]
    return dedupe.keep_first(facts(spark, folder), keys, ["predication_id"], ["predication_id", "h", "r", "t"])


def u11_simple_graph(spark, folder):
    return graph.simple_graph(facts(spark, folder), ["at", "predication_id"], ["r", "document_id", "model", "prompt"])


def f07_cleaned(spark, folder):
    return triples.cleaned(facts(spark, folder), ["h", "r", "t"]).groupBy("changed").agg(F.count("*").alias("n"))


def f04_normalised(spark, folder):
    return triples.normalised(facts(spark, folder)).groupBy("r").agg(F.count("*").alias("n"), F.count_distinct("h").alias("heads"), F.count_distinct("t").alias("tails"))


def j15_rekey(spark, folder):
    return triples.rekeyed(table(spark, folder, "predication"), u01_entity_dedupe(spark, folder)).select("predication_id", "subject_id", "object_id")


def j19_substring(spark, folder):
    terms = table(spark, folder, "vocab_entity").select(F.col("canonical_name").alias("term"))
    names = facts(spark, folder).select(F.explode(F.array("h", "t")).alias("entity_name"))
    return retrieval.substring_entries(names, terms)


def g23_bfs_triples(spark, folder):
    start = table(spark, folder, "vocab_entity").select(F.col("canonical_name").alias("entity_name"))
    return graph.collected_edges(facts(spark, folder), start, 2, "entity_name", "h", "t").select("predication_id", "depth")


def ask(spark, folder, question: str = "How does synaptic plasticity shape working memory?", k: int = 2):
    terms = spark.createDataFrame([(w.lower().strip("?.,"),) for w in question.split() if len(w) > 6], "term string")
    names = facts(spark, folder).select(F.explode(F.array("h", "t")).alias("entity_name"))
    entries = retrieval.substring_entries(names, terms).select("entity_name")
    return retrieval.ranked_triples(facts(spark, folder), entries, k, tie=("predication_id",))


def c10_ask(spark, folder):
    return ask(spark, folder)[0].select("predication_id", "document_id", "depth", "h", "r", "t")


def t16_prompt(spark, folder):
    """The prompt for a question: its triples, their documents' titles and abstracts."""
    found = written(c10_ask(spark, folder), "triples")
    texts = table(spark, folder, "kg_document").select("document_id", "title", F.col("abstract").alias("text"))
    question = F.lit("What shapes memory?")
    return retrieval.context(found, texts, question, "Facts:\n{context}\n\nQuestion: {query}\nAnswer:", ["depth", "h", "r", "t", "predication_id"])


def g17_reindex(spark, folder):
    ids, moved = graph.reindexed(nodes(spark, folder, "id"), edges(spark, folder).select("edge_id", "source", "target").distinct(), "id", "source", "target")
    return moved.select("edge_id", "new_source", "new_target")


FIELD_ORDER = ["neuroscience", "neuromorphic", "aiml"]


def g18_unify(spark, folder):
    return graph.unified(nodes(spark, folder, "id", "field"), FIELD_ORDER, "field", "id")


def g20_unified_edges(spark, folder):
    """Edges between unified nodes, by the unordered pair of their fields."""
    ids = nodes(spark, folder, "id", "field").where("field is not null")
    of = lambda end, n: ids.select(F.col("id").alias(end), F.col("field").alias(n))
    clean = edges(spark, folder).select("source", "target").where("source <> target").distinct()
    return graph.pair_counts(clean.join(of("source", "f1"), "source").join(of("target", "f2"), "target"), F.col("f1"), F.col("f2"))


def j08_internal_external(spark, folder):
    ids = nodes(spark, folder, "id").select(F.col("id").alias("target"), F.lit(1).alias("known"))
    return (
        edges(spark, folder).where("source is not null and target is not null").select("source", "target").distinct().join(ids, "target", "left")
        .groupBy("source").agg(F.count_if(F.col("known").isNotNull()).alias("internal"), F.count_if(F.col("known").isNull()).alias("external"))
    )


def a21_network_stats(spark, folder):
    clean = graph.without_loops(edges(spark, folder), "source", "target")
    n = nodes(spark, folder, "id").agg(F.count("*").alias("nodes"))
    return n.crossJoin(F.broadcast(clean.agg(F.count("*").alias("edges")))).select("nodes", "edges", (2 * F.col("edges") / F.col("nodes")).alias("avg_degree"))


def g14_isolates(spark, folder):
    return nodes(spark, folder, "id").select(F.col("id").alias("node")).join(graph.degrees(edges(spark, folder), "source", "target"), "node", "left_anti")


def g11_expansion(spark, folder):
    """Two hops from the nodes whose DOI a paper has."""
    dois = table(spark, folder, "papers").select(F.lower("doi").alias("d")).where("d is not null").distinct()
    seeds = nodes(spark, folder, "id", "doi").join(dois, F.lower("doi") == F.col("d"), "left_semi").select(F.col("id").alias("node"))
    return graph.expansion_events(edges(spark, folder), seeds, 2, "node", "source", "target")


def j05_event_edges(spark, folder):
    """Citation events by DOI, resolved to nodes again."""
    n = nodes(spark, folder, "id", "doi").where("doi is not null")
    of = lambda end, name: n.select(F.col("id").alias(end), F.col("doi").alias(name))
    events = edges(spark, folder).join(of("source", "citing_doi"), "source").join(of("target", "cited_doi"), "target").select("citing_doi", "cited_doi")
    return lookups.resolved_edges(events, n, "citing_doi", "cited_doi", "doi", "id")


def membership(spark, folder):
    """A labelling that the tables hold: the category of each node, as a number."""
    n = nodes(spark, folder, "id", "category").where("category is not null")
    return n.select(F.col("id").alias("node"), F.xxhash64("category").alias("community"), "category")


def _clean_edges(spark, folder):
    return graph.without_loops(graph.undirected(edges(spark, folder), "source", "target"))


def g03_louvain(spark, folder):
    return community.communities(_clean_edges(spark, folder), refine=False)


GAMMA = 0.01


def g06_leiden_cpm(spark, folder):
    """Parallel edges are kept."""
    return community.communities(edges(spark, folder), gamma=GAMMA, src="source", dst="target")


def g07_leiden_modularity(spark, folder):
    return community.communities(_clean_edges(spark, folder))


def g03_modularity_of_labels(spark, folder):
    labels = membership(spark, folder)
    inside = graph.induced(_clean_edges(spark, folder), labels)
    return graph.modularity(inside, labels).select(F.round("modularity", 9).alias("modularity"))


def a05_largest_community(spark, folder):
    return membership(spark, folder).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(1)


def g10_touching(spark, folder):
    """Nodes of the categories that hold a node cited more than a hundred times."""
    cited = edges(spark, folder).where("target is not null").groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n")).where("n > 100")
    return community.touching(membership(spark, folder).select("node", "community"), cited).select("node")


def g04_min_cluster(spark, folder):
    return community.at_least(membership(spark, folder).select("node", "community"), 20).select("node")


def top_cited(spark, folder, n: int = 100):
    counts = edges(spark, folder).where("target is not null").groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "node").limit(n)


def g09_steiner(spark, folder):
    return steiner.steiner(edges(spark, folder), top_cited(spark, folder), "node", "source", "target")


def g08_components(spark, folder):
    return graph.components(edges(spark, folder), "source", "target").groupBy("component").agg(F.count("*").alias("n"))


def j10_induced(spark, folder):
    part = nodes(spark, folder, "id", "field").where("field = 'aiml'").select(F.col("id").alias("node"))
    return graph.induced(edges(spark, folder).select("source", "target").distinct(), part, "node", "source", "target")


def g24_cluster_of_top(spark, folder):
    sizes = membership(spark, folder).groupBy("community", "category").agg(F.count("*").alias("size"))
    return top_cited(spark, folder).join(membership(spark, folder).select("node", "community"), "node").join(sizes, "community").select("node", "n", "category", "size")


QUERIES = {
    "k04_triple_projection": lambda s, d: facts(s, d).select("h", "r", "t", "document_id", "model", "predication_id"),
    "a03_duplicates": a03_duplicates,
    "u01_entity_dedupe": u01_entity_dedupe,
    "u03_pred_dedupe": u03_pred_dedupe,
    "u11_simple_graph": u11_simple_graph,
    "f04_normalised": f04_normalised,
    "f07_cleaned": f07_cleaned,
    "pr08_readable": lambda s, d: table(s, d, "entity").where(triples.readable(F.col("entity_name"))).select("entity_id"),
    "pr09_valid_triples": lambda s, d: facts(s, d).where(triples.is_valid(F.col("h"), F.col("r"), F.col("t"))).select("predication_id"),
    "j15_rekey": j15_rekey,
    "j19_substring": j19_substring,
    "j13_missing_docs": lambda s, d: table(s, d, "kg_document").select("document_id").join(facts(s, d).select("document_id").distinct(), "document_id", "left_anti"),
    "a06_entity_freq": lambda s, d: triples.entity_frequency(facts(s, d)).orderBy(F.desc("n"), "entity").limit(50),
    "a10_doc_freq": lambda s, d: triples.document_frequency(facts(s, d)).orderBy(F.desc("n"), "document_id").limit(5),
    "a19_combos": lambda s, d: facts(s, d).groupBy("document_id").agg(F.count_distinct(F.struct("model", "prompt")).alias("combos")),
    "a25_models_of_doc": lambda s, d: facts(s, d).groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models")),
    "g12_ontology": lambda s, d: triples.ontology_assertions(facts(s, d)),
    "g12_owl_lines": lambda s, d: triples.ontology_lines(facts(s, d), "http://example.org/kg"),
    "g13_integrity": lambda s, d: triples.integrity(facts(s, d), table(s, d, "entity")),
    "g16_top_subgraph": lambda s, d: graph.induced(facts(s, d).select("h", "t").distinct(), triples.entity_frequency(facts(s, d)).orderBy(F.desc("n"), "entity").limit(50).select(F.col("entity").alias("node")), "node", "h", "t"),
    "g23_bfs_triples": g23_bfs_triples,
    "c10_ask": c10_ask,
    "t16_prompt": t16_prompt,
    "x03_intersect": lambda s, d: facts(s, d).select(F.col("h").alias("entity")).intersect(facts(s, d).select(F.col("t").alias("entity"))),
    "x04_except": lambda s, d: facts(s, d).select(F.col("h").alias("entity")).subtract(facts(s, d).select(F.col("t").alias("entity"))),
    "u05_edge_clean": lambda s, d: graph.without_loops(edges(s, d), "source", "target"),
    "g02_undirected": lambda s, d: graph.undirected(edges(s, d), "source", "target"),
    "a22_degree_top20": lambda s, d: graph.top_by_degree(edges(s, d).select("source", "target").distinct(), 20, "source", "target"),
    "a04_top_cited": top_cited,
    "a21_network_stats": a21_network_stats,
    "j08_internal_external": j08_internal_external,
    "j10_induced": j10_induced,
    "j05_event_edges": j05_event_edges,
    "j23_common_citers": lambda s, d: lookups.common_citers(edges(s, d), "neuroscience", "neuromorphic"),
    "g14_isolates": g14_isolates,
    "g08_components": g08_components,
    "g08_lcc": lambda s, d: graph.largest_component(edges(s, d), "source", "target"),
    "g11_expansion": g11_expansion,
    "g17_reindex": g17_reindex,
    "g18_unify": g18_unify,
    "g20_unified_edges": g20_unified_edges,
    "g03_louvain": g03_louvain,
    "g06_leiden_cpm": g06_leiden_cpm,
    "g07_leiden_modularity": g07_leiden_modularity,
    "g03_modularity_of_labels": g03_modularity_of_labels,
    "a05_largest_community": a05_largest_community,
    "g04_min_cluster": g04_min_cluster,
    "g10_touching": g10_touching,
    "g09_steiner": g09_steiner,
    "g24_cluster_of_top": g24_cluster_of_top,
}

_KEY = TEXT_ORACLE["f01_match_key"].split("select entity_id, ")[1].split(" as value from")[0]


def _key(column: str) -> str:
    return _KEY.replace("entity_name", column)


_NODES = "(select * from citation_network_nodes qualify row_number() over (partition by id order by added_at, title nulls first, doi nulls first) = 1)"
_KEYED = f"(select *, {_key('subject_entity_name')} a, {_key('predicate')} b, {_key('object_entity_name')} c from predication)"
_LOOPLESS = "(select distinct source, target from citation_network_edges where source <> target)"
_PAIRS = "(select distinct least(source, target) s, greatest(source, target) t from citation_network_edges where source is not null and target is not null)"
_LABELS = f"(select id as node, category from {_NODES} where category is not null)"
_COMPONENTS = f"""with recursive e as (select s, t from {_PAIRS} union select t, s from {_PAIRS}),
    n as (select s x from e union select coalesce(source, target) from citation_network_edges where source is not null or target is not null union select coalesce(target, source) from citation_network_edges where source is not null or target is not null),
    walk(x, c) using key (x) as (select x, x from n union (select e.t, min(w.c) from walk w join e on e.s = w.x join recurring.walk o on o.x = e.t where w.c < o.c group by e.t))
    select x, c from walk"""
_SIMPLE_KEY = "coalesce(strftime(extracted_at, '%Y%m%d%H%M%S'), '0') || predication_id"
_ONTO = "select distinct translate(subject_entity_name, ' -', '__') subject, translate(predicate, ' -', '__') property, translate(object_entity_name, ' -', '__') object from predication where translate(predicate, ' -', '__') not in ('is_a','namespace','storid','name','save') and trim(subject_entity_name, ' ') <> '' and trim(predicate, ' ') <> '' and trim(object_entity_name, ' ') <> ''"
_ENTITY = lambda c: f"case when trim({c}) = '' then {c} else array_to_string(list_transform(list_filter(regexp_split_to_array(trim({c}), '{_SPACES}'), lambda w: w <> ''), lambda w: {_ENTITY_WORD.replace(_EXCLUDED, '')}), ' ') end"
_EXCLUDED = "when lower(w) in ('cmos', 'mos') then lower(w) "
_RELATION = TEXT_ORACLE["f03_relation_norm"].split("select predication_id, ")[1].split(" as value from")[0]
_XML = lambda c: f"""replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')"""
_IRI = "http://example.org/kg"
_OWL = f"""with f as ({_ONTO}) select '<owl:ObjectProperty rdf:about="{_IRI}#' || {_XML('property')} || '"/>' line from (select distinct property from f)
    union all select '<owl:NamedIndividual rdf:about="{_IRI}#' || {_XML('x')} || '"><rdf:type rdf:resource="{_IRI}#Entity"/></owl:NamedIndividual>' from (select subject x from f union select object from f)
    union all select '<rdf:Description rdf:about="{_IRI}#' || {_XML('subject')} || '"><p:' || regexp_replace(property, '[^\\w.-]', '_', 'g') || ' rdf:resource="{_IRI}#' || {_XML('object')} || '"/></rdf:Description>' from f"""
_ASK = """with f as (select predication_id, coalesce(document_id, '') document_id, subject_entity_name h, predicate r, object_entity_name t from predication),
    e as (select distinct x from (select h x from f union select t from f) where contains(lower(x), 'synaptic') or contains(lower(x), 'plasticity') or contains(lower(x), 'working') or contains(lower(x), 'memory')),
    d as (select distinct t x from f where h in (from e) and t is not null and t not in (from e)),
    n as (select *, case when h in (from e) then 0 else 1 end depth from f where h in (from e) or h in (from d)),
    top as (select document_id, count(*) k from n group by 1 order by 2 desc, encode(document_id) limit 5)
    select predication_id, document_id, depth, h, r, t from n join top using (document_id) order by k desc, encode(document_id), depth, encode(h), encode(r) nulls first, encode(t) nulls first, encode(predication_id) limit 20"""
_PROMPT = f"""with a as ({_ASK}), b as (select * from a order by depth, encode(h), encode(r) nulls first, encode(t) nulls first, encode(predication_id) limit 10),
    g as (select document_id, count(*) k from b group by 1 order by 2 desc, encode(document_id) limit 5),
    x as (select string_agg(coalesce(h, 'null') || ' | ' || coalesce(r, 'null') || ' | ' || coalesce(t, 'null'), chr(10) order by depth, encode(h), encode(r) nulls first, encode(t) nulls first, encode(predication_id)) v from b),
    y as (select string_agg(concat_ws(chr(10), title, abstract), chr(10) || chr(10) order by k desc, encode(document_id)) v from kg_document join g using (document_id))
    select 'Facts:' || chr(10) || concat_ws(chr(10) || chr(10), nullif(x.v, ''), nullif(y.v, '')) || chr(10) || chr(10) || 'Question: What shapes memory?' || chr(10) || 'Answer:' prompt from x, y"""
ORACLE = {
    "f04_normalised": f"select r, count(*) n, count(distinct h) heads, count(distinct t) tails from (select {_RELATION} r, {_ENTITY('subject_entity_name')} h, {_ENTITY('object_entity_name')} t from predication) group by 1",
    "f07_cleaned": "select changed, count(*) n from (select " + " + ".join(f"({_cleanup_sql(c)} is distinct from {c})::int" for c in ("subject_entity_name", "predicate", "object_entity_name")) + " changed from predication) group by 1",
    "g12_owl_lines": _OWL,
    "g13_integrity": """select 'blank_entity' check_name, (select count(*) from entity where trim(entity_name, ' ') = '') problems
        union all select 'unknown_end', (select count(*) from (select subject_entity_name x from predication union all select object_entity_name from predication) where x is not null and x not in (select entity_name from entity where entity_name is not null))
        union all select 'reserved_property', (select count(*) from predication where translate(predicate, ' -', '__') in ('is_a', 'namespace', 'storid', 'name', 'save'))
        union all select 'self_loop', (select count(*) from predication where subject_entity_name = object_entity_name)""",
    "c10_ask": _ASK,
    "t16_prompt": _PROMPT,
    "k04_triple_projection": "select subject_entity_name h, predicate r, object_entity_name t, document_id, model_name model, predication_id from predication",
    "a03_duplicates": f"select h, r, t, frequency::bigint frequency from (select subject_entity_name h, predicate r, object_entity_name t, count(*) over (partition by a, b, c) frequency from {_KEYED}) where frequency > 1 group by all",
    "u01_entity_dedupe": f"select entity_id, entity_name from entity qualify row_number() over (partition by {_key('entity_name')} order by created_at, entity_id) = 1",
    "u03_pred_dedupe": f"select predication_id, subject_entity_name h, predicate r, object_entity_name t from {_KEYED} qualify row_number() over (partition by a, b, c order by predication_id) = 1",
    "u11_simple_graph": "select subject_entity_name src, object_entity_name dst, "
    + ", ".join(f"arg_max({c}, {_SIMPLE_KEY}) filter (where {c} is not null) {n}" for c, n in (("predicate", "r"), ("document_id", "document_id"), ("model_name", "model"), ("prompt_filename", "prompt")))
    + " from predication where trim(subject_entity_name, ' ') <> '' and trim(object_entity_name, ' ') <> '' group by 1, 2",
    "pr08_readable": "select entity_id from entity where length(regexp_replace(entity_name, '[^a-zA-Z0-9]', '', 'g')) >= 2",
    "pr09_valid_triples": "select predication_id from predication where trim(subject_entity_name, ' ') <> '' and trim(predicate, ' ') <> '' and trim(object_entity_name, ' ') <> '' and lower(trim(subject_entity_name, ' ')) <> 'nan' and lower(trim(object_entity_name, ' ')) <> 'nan'",
    "j15_rekey": f"with s as (select entity_id, {_key('entity_name')} k from entity qualify row_number() over (partition by k order by created_at, entity_id) = 1) select predication_id, x.entity_id subject_id, y.entity_id object_id from {_KEYED} p left join s x on x.k = p.a left join s y on y.k = p.c",
    "j19_substring": "select distinct canonical_name term, entity_name from (select subject_entity_name entity_name from predication union select object_entity_name from predication) e join vocab_entity v on contains(lower(e.entity_name), lower(v.canonical_name))",
    "j13_missing_docs": "select document_id from kg_document where document_id not in (select document_id from predication where document_id is not null)",
    "a06_entity_freq": "select e entity, count(*) n from (select subject_entity_name e from predication union all select object_entity_name from predication) where e is not null group by 1 order by 2 desc, encode(e) limit 50",
    "a10_doc_freq": "select coalesce(document_id, '') document_id, count(*) n from predication group by 1 order by 2 desc, 1 limit 5",
    "a19_combos": "select document_id, count(distinct coalesce(model_name, '~') || '/' || coalesce(prompt_filename, '~')) combos from predication group by 1",
    "a25_models_of_doc": "select document_id, string_agg(model_name, ',' order by model_name) models from (select distinct document_id, model_name from predication) group by 1",
    "g12_ontology": _ONTO,
    "g16_top_subgraph": "with top as (select e, count(*) n from (select subject_entity_name e from predication union all select object_entity_name from predication) where e is not null group by 1 order by 2 desc, encode(e) limit 50) select distinct subject_entity_name h, object_entity_name t from predication where subject_entity_name in (select e from top) and object_entity_name in (select e from top)",
    "g23_bfs_triples": "with d0 as (select distinct canonical_name x from vocab_entity), d1 as (select distinct object_entity_name x from predication where subject_entity_name in (from d0) and object_entity_name is not null and object_entity_name not in (from d0)) select predication_id, case when subject_entity_name in (from d0) then 0 else 1 end as depth from predication where subject_entity_name in (from d0) or subject_entity_name in (from d1)",
    "x03_intersect": "select subject_entity_name entity from predication intersect select object_entity_name from predication",
    "x04_except": "select subject_entity_name entity from predication except select object_entity_name from predication",
    "u05_edge_clean": f"select source src, target dst from {_LOOPLESS}",
    "g02_undirected": f"select s src, t dst from {_PAIRS}",
    "a22_degree_top20": "select node, count(*) degree from (select unnest([source, target]) node from (select distinct source, target from citation_network_edges)) where node is not null group by 1 order by 2 desc, 1 limit 20",
    "a04_top_cited": "select target node, count(*) n from citation_network_edges where target is not null group by 1 order by 2 desc, 1 limit 100",
    "a21_network_stats": f"select n nodes, e edges, 2 * e / n avg_degree from (select count(*) n from {_NODES}), (select count(*) e from {_LOOPLESS})",
    "j08_internal_external": f"select source, count(*) filter (where n.id is not null) \"internal\", count(*) filter (where n.id is null) \"external\" from (select distinct source, target from citation_network_edges where source is not null and target is not null) e left join {_NODES} n on n.id = e.target group by 1",
    "j10_induced": f"select distinct source, target from citation_network_edges where source in (select id from {_NODES} where field = 'aiml') and target in (select id from {_NODES} where field = 'aiml')",
    "j05_event_edges": f"with n as (select id, doi from {_NODES} where doi is not null), m as (select doi, min(id) id from n group by 1) select distinct a.id source, b.id target from citation_network_edges e join n x on x.id = e.source join n y on y.id = e.target join m a on a.doi = x.doi join m b on b.doi = y.doi",
    "j23_common_citers": "with e as (select distinct field, source, target from citation_network_edges where source is not null and target is not null), g as (select field, target, count(*) n, string_agg(source::varchar, ';' order by source) c from e group by 1, 2) select l.target, l.n left_count, l.c left_citers, r.n right_count, r.c right_citers from g l join g r on l.target = r.target and l.field = 'neuroscience' and r.field = 'neuromorphic'",
    "g14_isolates": f"select id node from {_NODES} where id not in (select unnest([source, target]) from citation_network_edges where source is not null and target is not null union select source from citation_network_edges where source is not null union select target from citation_network_edges where target is not null)",
    "g11_expansion": f"""with e as (select source s, target t from {_LOOPLESS}), s0 as (select distinct id x from {_NODES} where lower(doi) in (select lower(doi) from papers where doi is not null)),
        h1 as (select s, t, t n from e where s in (from s0) and t not in (from s0) union all select s, t, s from e where t in (from s0) and s not in (from s0)),
        s1 as (select distinct n x from h1), k1 as (from s0 union from s1),
        h2 as (select s, t from e where s in (from s1) and t not in (from k1) union all select s, t from e where t in (from s1) and s not in (from k1))
        select s src, t dst, 1 hop from h1 union all select s, t, 2 from h2""",
    "g17_reindex": f"with i as (select id, row_number() over (order by id) - 1 k from {_NODES}) select edge_id, a.k new_source, b.k new_target from (select distinct edge_id, source, target from citation_network_edges) e left join i a on a.id = e.source left join i b on b.id = e.target",
    "g18_unify": f"select row_number() over (order by list_position(['neuroscience', 'neuromorphic', 'aiml'], field), field, id) - 1 global_id, field, id local_id from {_NODES} where field is not null",
    "g20_unified_edges": f"select least(a.field, b.field) \"first\", greatest(a.field, b.field) \"second\", count(*) n from {_LOOPLESS} e join {_NODES} a on a.id = e.source join {_NODES} b on b.id = e.target where a.field is not null and b.field is not null group by 1, 2",
    "g03_modularity_of_labels": f"""with e as (select a.category x, b.category y from {_PAIRS} p join {_LABELS} a on a.node = p.s join {_LABELS} b on b.node = p.t where p.s <> p.t),
        d as (select c, count(*) k from (select unnest([x, y]) c from e) group by 1) select round((select count(*) from e where x = y) / (select count(*) from e) - (select sum(k::double * k) / (sum(k)::double * sum(k)) from d), 9) modularity""",
    "a05_largest_community": f"select category, count(*) n from {_LABELS} group by 1 order by 2 desc, 1 limit 1",
    "g04_min_cluster": f"select node from {_LABELS} qualify count(*) over (partition by category) >= 20",
    "g10_touching": f"select node from {_LABELS} where category in (select category from {_LABELS} where node in (select target from citation_network_edges group by 1 having count(*) > 100))",
    "g24_cluster_of_top": f"with t as (select target node, count(*) n from citation_network_edges where target is not null group by 1 order by 2 desc, 1 limit 100), s as (select category, count(*) as size from {_LABELS} group by 1) select node, n, category, size from t join {_LABELS} l using (node) join s using (category)",
    "g08_components": f"select c component, count(*) n from ({_COMPONENTS}) group by 1",
    "g08_lcc": f"with w as ({_COMPONENTS}) select x node from w where c = (select c from w group by 1 order by count(*) desc, 1 limit 1)",
}

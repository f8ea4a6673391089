"""Tables of a knowledge graph built from triples: validation, clean-up, merging, re-keying, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import clean_up, entity_canonical, identifier, match_key, relation_canonical

#: Property names that an ontology keeps for itself.
RESERVED = ("is_a", "namespace", "storid", "name", "save")


def from_predications(predications: DataFrame) -> DataFrame:
    """h, r, t with their provenance."""
    return predications.select(
        F.col("subject_entity_name").alias("h"), F.col("predicate").alias("r"), F.col("object_entity_name").alias("t"),
        "document_id", F.col("model_name").alias("model"), "predication_id", F.col("prompt_filename").alias("prompt"), F.col("extracted_at").alias("at"),
    )


def is_valid(h: Column, r: Column, t: Column) -> Column:
    """All three there and not blank; ends are not the text of a missing number."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return filled(h) & filled(r) & filled(t) & (F.lower(F.trim(h)) != "nan") & (F.lower(F.trim(t)) != "nan")


def readable(value: Column) -> Column:
    """At least two letters or digits."""
    return F.length(F.regexp_replace(value, "[^a-zA-Z0-9]", "")) >= 2


def normalised(triples: DataFrame, exclusions: tuple[str, ...] = ()) -> DataFrame:
    """Triples with canonical ends and relations; other columns stay."""
    return triples.withColumns(
        {"h": entity_canonical(F.col("h"), exclusions), "r": relation_canonical(F.col("r"), exclusions), "t": entity_canonical(F.col("t"), exclusions)}
    )


def cleaned(df: DataFrame, fields: list[str]) -> DataFrame:
    """Fields after the clean-up rules, and ``changed``: how many of them differ."""
    new = {f: clean_up(F.col(f)) for f in fields}
    changed = sum((~F.col(f).eqNullSafe(c)).cast("int") for f, c in new.items())
    return df.withColumn("changed", changed).withColumns(new)


def rekeyed(predications: DataFrame, entities: DataFrame, raw: bool = False) -> DataFrame:
    """Predications with ``subject_id`` and ``object_id`` of the surviving entities, by match key or by the raw name."""
    key = (lambda c: c) if raw else match_key
    ids = entities.select(key(F.col("entity_name")).alias("__k"), F.col("entity_id").alias("__id")).groupBy("__k").agg(F.min("__id").alias("__id"))
    for end in ("subject", "object"):
        side = ids.select(F.col("__k").alias(f"__{end}"), F.col("__id").alias(f"{end}_id"))
        predications = predications.withColumn("__key", key(F.col(f"{end}_entity_name"))).join(side, F.col("__key") == F.col(f"__{end}"), "left").drop("__key", f"__{end}")
    return predications


def entity_frequency(triples: DataFrame, h: str = "h", t: str = "t") -> DataFrame:
    """``entity, n``: as subject and as object."""
    return triples.select(F.explode(F.array(h, t)).alias("entity")).where("entity is not null").groupBy("entity").agg(F.count("*").alias("n"))


def document_frequency(triples: DataFrame) -> DataFrame:
    """``document_id, n``; triples without a document are counted under ''."""
    return triples.groupBy(F.coalesce("document_id", F.lit("")).alias("document_id")).agg(F.count("*").alias("n"))


def ontology_assertions(triples: DataFrame) -> DataFrame:
    """``subject, property, object`` as an ontology names them: identifiers, each once, reserved properties left out."""
    return (
        triples.select(identifier(F.col("h")).alias("subject"), identifier(F.col("r")).alias("property"), identifier(F.col("t")).alias("object"))
        .where(~F.col("property").isin(*RESERVED) & (F.trim("subject") != "") & (F.trim("object") != "") & (F.trim("property") != ""))
        .distinct()
    )


def ontology_lines(triples: DataFrame, iri: str) -> DataFrame:
    """``line``: an OWL document in RDF/XML, one element a row (header and footer are the writer's)."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    facts = ontology_assertions(triples)
    properties = facts.select("property").distinct().select(F.format_string('<owl:ObjectProperty rdf:about="%s#%s"/>', F.lit(iri), escaped("property")).alias("line"))
    individuals = facts.select(F.explode(F.array("subject", "object")).alias("x")).distinct().select(
        F.format_string('<owl:NamedIndividual rdf:about="%s#%s"><rdf:type rdf:resource="%s#Entity"/></owl:NamedIndividual>', F.lit(iri), escaped("x"), F.lit(iri)).alias("line")
    )
    links = facts.select(
        F.format_string('<rdf:Description rdf:about="%s#%s"><p:%s rdf:resource="%s#%s"/></rdf:Description>', F.lit(iri), escaped("subject"), F.regexp_replace("property", r"[^\w.-]", "_"), F.lit(iri), escaped("object")).alias("line")
    )
    return properties.unionByName(individuals).unionByName(links)


def integrity(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """``check_name, problems``: what a consistency report lists."""
    names = entities.select(F.col("entity_name").alias("x")).distinct()
    ends = triples.select(F.explode(F.array("h", "t")).alias("x")).where("x is not null")
    checks = {
        "blank_entity": entities.where(F.trim("entity_name") == ""),
        "unknown_end": ends.join(names, "x", "left_anti"),
        "reserved_property": triples.where(identifier(F.col("r")).isin(*RESERVED)),
        "self_loop": triples.where("h = t"),
    }
    counted = [d.agg(F.count("*").alias("problems")).select(F.lit(k).alias("check_name"), "problems") for k, d in checks.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out

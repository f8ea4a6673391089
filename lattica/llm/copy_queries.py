"""Queries of problem 5: duplicates hidden by formatting differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.exact_copies import collapsed, copies
from lattica.sources.tables import table

#: table -> its key, and per field whether it is a name (``B, A`` means ``A B``).
FIELDS = {
    "entity": ("entity_id", {"entity_name": True}),
    "predication": ("predication_id", {"subject_entity_name": True, "predicate": False, "object_entity_name": True}),
}


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = [
        copies(table(spark, folder, name), key, fields).select(F.lit(name).alias("table_name"), "first_key", "copy_key")
        for name, (key, fields) in FIELDS.items()
    ]
    return found[0].unionByName(found[1])


def p5_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The entities with each content once, and their number of copies."""
    key, fields = FIELDS["entity"]
    return collapsed(table(spark, folder, "entity"), key, fields)


def p5_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The facts with each content once, and their number of copies."""
    key, fields = FIELDS["predication"]
    return collapsed(table(spark, folder, "predication"), key, fields)


_KEPT = r"\p{L}\p{M}\p{N}+"
_SPACE = r"\s\x{200b}-\x{200d}\x{2060}\x{feff}\x{a0}\x{2009}\x{3000}"


def _content(col: str, name: bool) -> str:
    v = f"lower(upper({col}))"
    if name:
        v = rf"regexp_replace({v}, '(?s)^([^,]*[{_KEPT}][^,]*),[{_SPACE}]+([^,]*[{_KEPT}][^,]*)$', '\2 \1')"
    # marks between digits are set apart first: RE2 has no look-behind
    v = rf"regexp_replace({v}, '(\p{{Nd}})([^{_KEPT}{_SPACE}])(\p{{Nd}})', '\1' || chr(57344) || '\2' || chr(57345) || '\3', 'g')"
    v = rf"regexp_replace({v}, '(\p{{Nd}})([^{_KEPT}{_SPACE}])(\p{{Nd}})', '\1' || chr(57344) || '\2' || chr(57345) || '\3', 'g')"
    return rf"coalesce(regexp_replace({v}, '(\x{{e000}}.\x{{e001}})|[^{_KEPT}]', '\1', 'g'), chr(1))"


def _grouped(name: str) -> str:
    key, fields = FIELDS[name]
    content = " || chr(2) || ".join(_content(f, n) for f, n in fields.items())
    return f"select *, min({key}) over (partition by content) first_key, count(*) over (partition by content) copies from (select *, {content} content from {name})"


QUERIES = {"p5_found": p5_found, "p5_entities": p5_entities, "p5_facts": p5_facts}
ORACLE = {
    "p5_found": " union all ".join(
        f"select '{n}' table_name, first_key, {k} copy_key from ({_grouped(n)}) where {k} <> first_key" for n, (k, _) in FIELDS.items()
    ),
    "p5_entities": f"select entity_id, entity_name, copies from ({_grouped('entity')}) where entity_id = first_key",
    "p5_facts": f"select predication_id, subject_entity_name, predicate, object_entity_name, copies from ({_grouped('predication')}) where predication_id = first_key",
}

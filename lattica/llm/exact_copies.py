"""Duplicates hidden by formatting, found by refining a partition from cheap keys to costly ones.

Content of a value: its letters, digits and ``+`` in order, without letter case. White space, punctuation and other
signs are formatting, except a mark directly between two digits. ``B, A`` (one comma, white space, text on both sides)
means ``A B`` where the field is a name.

Step 1 gives each row an invariant that no formatting and no swap of parts can change: per field the number of ASCII
letters, digits and ``+``, and a coarse letter histogram of the row. It costs a few character translations and no
regular expression. Only classes of several rows go on. Step 2 builds the exact content of those rows and groups by
its 128-bit digest. Both groupings are pre-aggregated; copies meet their group's row in plain joins, which Spark
splits where one group is hot, so no group is ever collected.

Defined cases: null is a value of its own (two nulls in the same field are the same); values without content (empty,
only signs) equal each other; a null id is kept and sorts first; repeated ids give one copy row; empty tables give
empty results; other columns are ignored. Letters are compared in the composed or decomposed form they are stored in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.session import written

#: Letter classes of the histogram: frequent letters apart, so that the classes split evenly.
HISTOGRAM = ("ae", "ion", "rst", "dlcu")
_SIMPLE = "abcdefghijklmnopqrstuvwxyz0123456789+"
_SPACE = r"\s\u200b-\u200d\u2060\ufeff"
_KEPT = r"\p{L}\p{M}\p{N}+"
#: Formatting: a sign that is not directly between two digits, and all white space.
_FORMATTING = rf"(?U)[{_SPACE}]|(?<!\p{{Nd}})[^{_KEPT}]|[^{_KEPT}](?!\p{{Nd}})"
_SWAPPED = rf"(?U)^([^,]*[{_KEPT}][^,]*),[{_SPACE}]+([^,]*[{_KEPT}][^,]*)$"


def folded(value: Column) -> Column:
    """Without letter case, so that all case variants of a letter are one (upper first: ß is SS, and µ is μ). What stands
    between keeps the optimiser from dropping the inner step."""
    return F.lower(F.concat(F.upper(value), F.lit("")))


def content(value: Column, name: bool) -> Column:
    """The content of a value; ``name``: two parts parted by a comma are put in order."""
    value = folded(value)
    if name:
        value = F.when(F.contains(value, F.lit(",")), F.regexp_replace(value, _SWAPPED, "$2 $1")).otherwise(value)
    return F.regexp_replace(value, _FORMATTING, "")


def invariant(values: list[Column]) -> Column:
    """A hash of what is alike in all copies whatever their formatting."""
    low = [F.coalesce(folded(v), F.lit("")) for v in values]
    count = lambda v, chars: F.length(v) - F.length(F.translate(v, chars, ""))
    row = F.concat(*low)
    return F.xxhash64(
        *[F.when(v.isNull(), -1).otherwise(count(x, _SIMPLE)) for v, x in zip(values, low)],
        *[count(row, letters) for letters in HISTOGRAM],
    )


def _keyed(df: DataFrame, key: str, fields: dict[str, bool]) -> DataFrame:
    """key and the fields under neutral names, so that no column can clash."""
    return df.select(F.col(key).cast("string").alias("k"), *[F.col(f).cast("string").alias(f"v{i}") for i, f in enumerate(fields)])


def copy_classes(df: DataFrame, key: str, fields: dict[str, bool]) -> DataFrame:
    """``k``, ``digest`` of each row that may have copies. ``fields``: name -> whether ``B, A`` means ``A B`` in it."""
    rows = _keyed(df, key, fields)
    values = [F.col(f"v{i}") for i in range(len(fields))]
    rows = written(rows.withColumn("inv", invariant(values)), "invariants")  # read twice, computed once
    several = rows.groupBy("inv").agg(F.count("*").alias("n")).where("n > 1").select("inv")
    parts = [F.coalesce(content(v, name), F.lit("\x00")) for v, name in zip(values, fields.values())]
    return rows.join(several, "inv", "left_semi").select("k", F.unhex(F.md5(F.concat_ws("\x01", *parts))).alias("digest"))


def copies(df: DataFrame, key: str, fields: dict[str, bool]) -> DataFrame:
    """``first_key, copy_key``: every copy with the smallest key of its group."""
    rows = written(copy_classes(df, key, fields), "classes")
    groups = rows.groupBy("digest").agg(F.min("k").alias("first_key"), F.count("*").alias("n")).where("n > 1")
    return (
        rows.join(groups.select("digest", "first_key"), "digest")
        .where(~F.col("k").eqNullSafe(F.col("first_key")))
        .select("first_key", F.col("k").alias("copy_key"))
    )


def collapsed(df: DataFrame, key: str, fields: dict[str, bool]) -> DataFrame:
    """One record for each content: its smallest key, the values as they stand there, and ``copies``."""
    rows = written(copy_classes(df, key, fields), "classes")
    groups = rows.groupBy("digest").agg(F.min("k").alias("k"), F.count("*").alias("copies")).where("copies > 1")
    kept = _keyed(df, key, fields)
    later = rows.join(groups.select("digest", F.col("k").alias("first")), "digest").where("k <> first").select("k")
    return (
        kept.join(later, "k", "left_anti")
        .join(groups.select("k", "copies"), "k", "left")
        .select(F.col("k").alias(key), *[F.col(f"v{i}").alias(f) for i, f in enumerate(fields)], F.coalesce("copies", F.lit(1)).alias("copies"))
    )

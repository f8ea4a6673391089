"""Papers as text and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def section_text(sections: Column, field: str = "body") -> Column:
    """Bodies of all sections, a blank between; no sections give an empty text."""
    bodies = F.transform(sections, lambda s: F.coalesce(s[field].cast("string"), F.lit("")))
    return F.coalesce(F.array_join(bodies, " "), F.lit(""))


def paper_text(title: Column, sections: Column) -> Column:
    """Title, then heading and body of each section, parted by blank lines; what is missing is left out."""
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    parts = F.flatten(F.transform(sections, lambda s: F.array(filled(s["heading"]), filled(s["body"]))))
    every = F.concat(F.array(filled(title)), F.coalesce(parts, F.array().cast("array<string>")))
    return F.array_join(F.filter(every, lambda x: x.isNotNull()), "\n\n")


def template(nodes: DataFrame) -> DataFrame:
    """A paper record for each node: file name, figures folder, and the abstract as its section if there is one."""
    return nodes.select(
        F.concat(F.col("id").cast("string"), F.lit(".pdf")).alias("pdf_filename"), "title", "doi",
        F.concat(F.lit("figures/"), F.col("id").cast("string")).alias("figures_folder"),
        F.when(F.trim("abstract") != "", F.array(F.struct(F.lit("Abstract").alias("section_title"), F.col("abstract").alias("section_text"))))
        .otherwise(F.array().cast("array<struct<section_title:string,section_text:string>>"))
        .alias("sections"),
    )


def download_commands(nodes: DataFrame, url: str = "pdf_url", key: str = "id", blocked: tuple[str, ...] = ("unable", "dropbox")) -> DataFrame:
    """``id, command``: a fetch command for each node whose URL is there and holds no blocked word."""
    low = F.lower(F.col(url))
    bad = low.contains(blocked[0])
    for word in blocked[1:]:
        bad = bad | low.contains(word)
    return nodes.where((F.trim(F.col(url)) != "") & ~bad).select(
        F.col(key).alias("id"), F.format_string("wget -O '%s.pdf' '%s'", F.col(key).cast("string"), F.col(url)).alias("command")
    )


def range_slice(df: DataFrame, order: str, begin: int, end: int) -> DataFrame:
    """Rows begin..end-1 in the order given."""
    return df.orderBy(order).offset(begin).limit(max(0, end - begin))

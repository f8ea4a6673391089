"""Readers and writers of the flat files that the pipelines exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.dedupe import dense_ids

TRIPLE = "h string, r string, t string, _model string, _prompt string, _bad string"
PAPER = (
    "pdf_filename string, title string, doi string, sections array<struct<level int, heading string, body string, content string,"
    " section_title string, section_text string>>, figures_folder string, figure_count int, docling_processed boolean,"
    " marker_processed boolean, error string"
)


def _stem() -> F.Column:
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def read_piped(spark: SparkSession, paths: list[str] | str, schema: str | None = None) -> DataFrame:
    """Pipe-delimited tables with a header, and ``file_stem``. Values that name no number stay text."""
    reader = spark.read.option("header", True).option("sep", "|").option("escape", '"').option("multiLine", False)
    df = (reader.schema(schema) if schema else reader).csv(paths)
    return df.select("*", _stem().alias("file_stem"))


def write_piped(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("sep", "|").option("escape", '"').mode("overwrite").csv(path)


def write_table(df: DataFrame, path: str, *order: str) -> None:
    """Comma-separated with a header; with ``order`` the parts follow each other in that order (a range sort, no single task)."""
    (df.orderBy(*order) if order else df).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def append_triples(df: DataFrame, path: str) -> None:
    """JSON lines in a folder for each document, added to what is there."""
    df.write.mode("append").partitionBy("document_id").json(path)


def append_traces(df: DataFrame, path: str, at: str) -> None:
    """Events as JSON lines in a folder for each day, added to what is there."""
    df.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").json(path)


def parted_by_error(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows that went well and, for a log of their own, those with an error."""
    bad = F.trim(F.coalesce(F.col(error), F.lit(""))) != ""
    return df.where(~bad), df.where(bad)


def result_record(triples: DataFrame, documents: DataFrame, query: str, order: list[str], most: int = 20) -> DataFrame:
    """``result``: one JSON text of a query, its triples (the first ``most`` in order) and its documents."""
    listed = lambda df, keys, n: df.orderBy(*keys).limit(n).agg(F.collect_list(F.struct(*df.columns)).alias("x"))
    found, texts = listed(triples, order, most).withColumnRenamed("x", "triples"), listed(documents, documents.columns, most).withColumnRenamed("x", "documents")
    return found.crossJoin(F.broadcast(texts)).select(F.to_json(F.struct(F.lit(query).alias("query"), "triples", "documents")).alias("result"))  # one row each


def read_triples(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """JSON lines of triples, with the document's id from the file name; blank lines and broken ones are left out."""
    df = spark.read.schema(TRIPLE).option("columnNameOfCorruptRecord", "_bad").json(paths)
    return df.select("*", _stem().alias("document_id")).where("_bad is null").drop("_bad")


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of papers; the three layouts of sections in one schema."""
    df = spark.read.schema(PAPER).option("multiLine", True).json(path)
    section = lambda s: F.struct(
        s["level"].alias("level"), F.coalesce(s["heading"], s["section_title"]).alias("heading"),
        F.coalesce(s["body"], s["section_text"], s["content"]).alias("body"),
    )
    return df.withColumn("sections", F.transform("sections", section))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``document_id, text`` of a folder of text files, a row each."""
    return spark.read.text(path, wholetext=True).select(_stem().alias("document_id"), F.col("value").alias("text"))


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node long, community long").option("sep", "\t").csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without surrounding blanks; empty ones are left out."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``file_no, line_no, line`` of a log and its rotations (.1, .2, …), the newest file first. Lines are read in splits
    and numbered in the order of their places, so a large log is no single row or task."""
    rotation = F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), r"\.(\d+)$", 1).try_cast("int"), F.lit(0))
    lines = spark.read.text(path).select(rotation.alias("file_no"), F.col("_metadata.file_block_start").alias("__from"), F.monotonically_increasing_id().alias("__at"), F.col("value").alias("line"))
    numbered = dense_ids(lines, ["file_no", "__from", "__at"], "__n")
    first = numbered.groupBy("file_no").agg(F.min("__n").alias("__first"))  # one row a file
    return numbered.join(F.broadcast(first), "file_no").select("file_no", (F.col("__n") - F.col("__first")).cast("int").alias("line_no"), "line")


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths (patterns too) under which there is something: a missing folder is no error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = lambda p: jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(p))
    return [p for p in paths if found(p)]


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of the paths that is there: refined before deduplicated before merged tables."""
    found = existing(spark, paths)
    if not found:
        raise FileNotFoundError(f"none of these is there: {', '.join(paths)}")
    return found[0]


def entity_names(spark: SparkSession, paths: list[str], column: str = "entity_name") -> DataFrame:
    """The names of the first table that is there; null and blank ones are left out."""
    return read_piped(spark, first_existing(spark, paths)).select(column).where(F.trim(column) != "").distinct()


def read_merged(spark: SparkSession, folders: list[str], pattern: str, schema: str) -> DataFrame:
    """Piped tables of many output folders as one; folders that are not there are passed over."""
    paths = existing(spark, [f"{f.rstrip('/')}/{pattern}" for f in folders])
    return read_piped(spark, paths, schema) if paths else spark.createDataFrame([], schema + ", file_stem string")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comma-separated nodes or edges with a header."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def listing(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``path, name, stem, size`` of the files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("length").alias("size"))


def graphml_lines(vertices: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst", label: str = "relation") -> DataFrame:
    """``part, line`` of a GraphML document; part 0 and 3 are its frame. Sorting by part and line gives the document."""
    text = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    spark = vertices.sparkSession
    frame = spark.createDataFrame(
        [
            (0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="edge" attr.name="relation" attr.type="string"/><graph edgedefault="directed">'),
            (3, "</graph></graphml>"),
        ],
        "part int, line string",
    )
    nodes = vertices.select(F.lit(1).alias("part"), F.format_string('<node id="%s"/>', text(node)).alias("line"))
    links = edges.select(F.lit(2).alias("part"), F.format_string('<edge source="%s" target="%s"><data key="d0">%s</data></edge>', text(src), text(dst), text(label)).alias("line"))
    return frame.unionByName(nodes).unionByName(links)


def read_graphml_edges(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst, relation`` of a GraphML file's edges."""
    df = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string, data string").load(path)
    return df.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.col("data").alias("relation"))


def recorded_responses(spark: SparkSession, path: str) -> DataFrame:
    """Responses of an external model or service as recorded: ``request_id, response, error``."""
    return spark.read.schema("request_id string, response string, error string").json(path)

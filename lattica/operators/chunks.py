"""Splitting of source files: by definitions for Python, by line windows for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def line_windows(df: DataFrame, key: str, text: str, lines: int = 300) -> DataFrame:
    """``key, window_no, first_line, chunk``: each text in pieces of so many lines."""
    listed = F.split(text, "\r?\n")
    n = F.size("lines")
    return (
        df.select(F.col(key).alias("key"), listed.alias("lines"))
        .select("key", "lines", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / lines).cast("int"))).alias("window_no"))
        .select(
            "key", "window_no", (F.col("window_no") * lines + 1).alias("first_line"),
            F.array_join(F.slice("lines", F.col("window_no") * lines + 1, F.lit(lines)), "\n").alias("chunk"),
        )
    )


def python_definitions(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, name, first_line, last_line``: the top-level definitions of a text that parses as Python, and the methods
    of its classes; texts that don't parse give none. The parser runs in Arrow batches, text by text."""
    kind = df.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast
        import warnings

        warnings.simplefilter("ignore")
        definitions = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
        for batch in batches:
            rows = []
            for k, source in zip(batch["key"], batch["text"]):
                try:
                    body = ast.parse(source).body
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                for node in body:
                    if isinstance(node, definitions):
                        rows.append((k, node.name, node.lineno, node.end_lineno))
                        inner = node.body if isinstance(node, ast.ClassDef) else []
                        rows += [(k, f"{node.name}.{m.name}", m.lineno, m.end_lineno) for m in inner if isinstance(m, definitions)]
            yield pd.DataFrame(rows, columns=["key", "name", "first_line", "last_line"])

    texts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return texts.mapInPandas(parse, f"key {kind}, name string, first_line int, last_line int")


def python_chunks(df: DataFrame, key: str, text: str, whole: bool = False) -> DataFrame:
    """``key, name, chunk``: each definition's lines, and '<module>' with what stands before the first one. ``whole``:
    texts that don't parse or have no definitions are one chunk '<module>'."""
    found = python_definitions(df, key, text).where(~F.col("name").contains("."))
    lines = df.select(F.col(key).alias("key"), F.split(text, "\r?\n").alias("lines"))
    joined = found.join(lines, "key")
    first = F.min("first_line").over(Window.partitionBy("key"))
    chunks = joined.select("key", "name", F.array_join(F.slice("lines", F.col("first_line"), F.col("last_line") - F.col("first_line") + 1), "\n").alias("chunk"))
    head = joined.withColumn("first", first).where("first_line = first and first > 1").select(
        "key", F.lit("<module>").alias("name"), F.array_join(F.slice("lines", F.lit(1), F.col("first") - 1), "\n").alias("chunk")
    )
    chunks = chunks.unionByName(head)
    if not whole:
        return chunks
    texts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lit("<module>").alias("name"), F.col(text).alias("chunk"))
    return chunks.unionByName(texts.join(found.select("key").distinct(), "key", "left_anti"))


def python_api(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind, name, signature, doc``: the public functions and classes of a text that parses as Python, and the public
    methods of these classes, with their arguments and the first line of their docstring; other texts give none."""
    kind = df.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast
        import warnings

        warnings.simplefilter("ignore")
        functions = (ast.FunctionDef, ast.AsyncFunctionDef)

        def entry(k, node, name):
            signature = ast.unparse(node.args) if isinstance(node, functions) else ", ".join(map(ast.unparse, node.bases))
            doc = (ast.get_docstring(node) or "").strip().split("\n")[0]
            return k, "function" if isinstance(node, functions) else "class", name, signature, doc

        for batch in batches:
            rows = []
            for k, source in zip(batch["key"], batch["text"]):
                try:
                    body = ast.parse(source).body
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                for node in body:
                    if isinstance(node, (*functions, ast.ClassDef)) and not node.name.startswith("_"):
                        rows.append(entry(k, node, node.name))
                        inner = node.body if isinstance(node, ast.ClassDef) else []
                        rows += [entry(k, m, f"{node.name}.{m.name}") for m in inner if isinstance(m, functions) and (m.name == "__init__" or not m.name.startswith("_"))]
            yield pd.DataFrame(rows, columns=["key", "kind", "name", "signature", "doc"])

    texts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return texts.mapInPandas(parse, f"key {kind}, kind string, name string, signature string, doc string")

"""Readers of the study's inputs: table corpora, queries, records, CSV results, prices. All return DataFrames."""

from __future__ import annotations

import csv
import gzip
import hashlib
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from murmura.sources import nested

TABLE = "id string, file_name string, sheet_name string, header string, instances string, metadata map<string,string>"
QUERY = "id string, query_id string, question string, ground_truth_list array<struct<id:string>>, answer string, sql string"


def _parsed(text: pd.Series, strip: bool) -> pd.Series:
    def row(t):
        if t is None or t == "":
            return []
        dialect = {"escapechar": "\\", "doublequote": True} if strip else {}
        try:
            cells = next(csv.reader(io.StringIO(t), **dialect), [])
        except csv.Error:
            cells = [t]
        return [c.strip() for c in cells] if strip else cells

    return text.map(row)


@F.pandas_udf(ArrayType(StringType()))
def csv_cells(text: pd.Series) -> pd.Series:
    """A CSV line of any width to trimmed cells: quote ", escape backslash; empty text gives none."""
    return _parsed(text, True)


@F.pandas_udf(ArrayType(StringType()))
def csv_cells_plain(text: pd.Series) -> pd.Series:
    """A CSV line in the default dialect, untrimmed; a line that cannot be read is one cell."""
    return _parsed(text, False)


def _last(df: DataFrame, key: str) -> DataFrame:
    """The last row of each key, by file and place in it."""
    order = Window.partitionBy(key).orderBy(F.desc("_file"), F.desc("_place"))
    return df.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_file", "_place")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a stated schema, one pass, bad lines skipped, each with its place in the input."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_place"))
    rows = lines.select(F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"), "_file", "_place")
    return rows.filter("r is not null and r._bad is null").select("r.*", "_file", "_place").drop("_bad")


def header_rows(header: Column) -> Column:
    """A header as JSON text as rows of cells: a CSV string, or a list with one, is parsed; a list of cells is one row; a list of rows stays."""
    rows = F.from_json(header, "array<array<string>>")
    cells = F.from_json(header, "array<string>")
    kind = F.when(header.rlike(r"^\s*\[\s*\["), "rows").when(header.rlike(r"^\s*\["), "cells").otherwise("line")
    line = F.when(kind == "line", header).when((kind == "cells") & (F.size(cells) == 1), F.get(cells, F.lit(0)))
    return F.when(header.isNull(), F.array().cast("array<array<string>>")).when(kind == "rows", rows).when(line.isNotNull(), F.array(csv_cells(line))).otherwise(F.array(cells))


def tables(spark: SparkSession, path: str) -> DataFrame:
    """id, file_name, sheet_name, header (rows of cells), instances (rows of cells), metadata; of equal ids the last line counts.

    Instances may be lists of cells or CSV strings.
    """
    raw = _last(_json(spark, path, TABLE), "id")
    lists = F.from_json("instances", "array<array<string>>")
    lines = F.from_json("instances", "array<string>")
    flat = raw.withColumn("header", header_rows(F.col("header"))).withColumn("_lists", F.when(~F.col("instances").rlike(r'^\s*\[\s*"'), lists)).withColumn("_lines", F.when(F.col("instances").rlike(r'^\s*\[\s*"'), lines))
    split = flat.select("id", F.posexplode("_lines").alias("_n", "_line")).withColumn("_cells", csv_cells(F.col("_line")))
    split = split.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_cells"))), lambda x: x["_cells"]).alias("_rows"))
    none = F.array().cast("array<array<string>>")
    return flat.join(split, "id", "left").withColumn("instances", F.coalesce("_rows", "_lists", none)).drop("_lists", "_lines", "_rows")


def queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, question, gold_ids, answer; sql stands in for a missing answer, id for a missing query_id. Repeats stay: see last_by_key()."""
    raw = _json(spark, path, QUERY)
    return raw.select(F.coalesce("query_id", "id").alias("query_id"), "question", F.coalesce(F.transform("ground_truth_list", lambda x: x["id"]), F.array().cast("array<string>")).alias("gold_ids"), F.coalesce("answer", "sql").alias("answer"), "_file", "_place")


def last_by_key(rows: DataFrame, key: str = "query_id") -> DataFrame:
    return _last(rows, key)


def first_by(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each key, by file and place."""
    order = Window.partitionBy(key).orderBy("_file", "_place")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_file", "_place")


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records, file by file: from lines, or from a whole document that is a list, or holds one in records, results or data, or is a record itself; what cannot be read is skipped.

    Lines are read as lines. A document is read by as many tasks as it has byte ranges
    (see nested.py), so neither its size nor its lack of line breaks matters. Files
    called .jsonl are lines, those called .json documents; others are told by how they
    begin. No file name comes to the driver.
    """
    parts = nested.pieces(spark, path)
    heads = parts.withColumn("_place", F.monotonically_increasing_id()).filter("start = 0").groupBy("file").agg(F.min_by("value", "_place").alias("value"))
    whole = heads.filter(nested.is_document()).select("file")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).join(whole, "file", "left_anti").select("value")
    values = lines.unionByName(nested.documents(parts.join(whole, "file", "left_semi")))
    rows = values.select(F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.filter("r is not null and r._bad is null").select("r.*").drop("_bad")


def attach_tables(asked: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id and its gold tables, in the order of gold_ids; ids without a table drop out, and so do queries without any."""
    ids = asked.select("query_id", F.posexplode("gold_ids").alias("position", "id"))
    met = ids.join(corpus, "id")
    return met.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct(*corpus.columns).alias("t"))), lambda a, b: a["position"] - b["position"]), lambda x: x["t"]).alias("tables"))


def cell_map(corpus: DataFrame) -> DataFrame:
    """(table_id, row, col, position, cell) of every data cell that is not blank; position counts them through the table, rows and columns start at 0."""
    rows = corpus.select(F.col("id").alias("table_id"), F.posexplode("instances").alias("row", "cells"))
    cells = rows.select("table_id", "row", F.posexplode("cells").alias("col", "cell")).filter("trim(cell) <> ''")
    place = F.row_number().over(Window.partitionBy("table_id").orderBy("row", "col")) - 1
    return cells.withColumn("position", place).select("table_id", "row", "col", "position", "cell")


def gold_map(asked: DataFrame) -> DataFrame:
    """(query_id, gold_ids) of the last line of each query; ids as text, in their order, none twice."""
    return last_by_key(asked).select("query_id", F.array_distinct(F.filter("gold_ids", lambda x: x.isNotNull())).alias("gold_ids"))


REPRESENTATION = "id string, table_id string, representation string, metadata map<string,string>"


def representations(spark: SparkSession, path: str) -> DataFrame:
    """(id, representation, metadata); table_id stands in for a missing id, and of equal ids the last line counts."""
    raw = _json(spark, path, REPRESENTATION).withColumn("id", F.coalesce("id", "table_id")).drop("table_id").filter("id is not null")
    return _last(raw, "id")


def retrievals(spark: SparkSession, path: str, top: int | None = None) -> DataFrame:
    """(question, rank, id, score) of cached retrieval lines {question, results: [{id, score}]}: ranks from 1 in the order of the list, the first ``top`` of them."""
    raw = _json(spark, path, "question string, results array<struct<id:string,score:double>>")
    rows = raw.select("question", F.posexplode("results").alias("place", "r")).select("question", (F.col("place") + 1).alias("rank"), "r.id", "r.score")
    return rows if top is None else rows.filter(F.col("rank") <= top)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, parent, path, length, modified) of the files under a path, by Spark's own file source, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("parent"), "path", "length", "modified")


def first_match(names: DataFrame, classes: list[Column]) -> DataFrame:
    """The one row of ``names`` (name, ...) in the earliest of the classes that any name fits; of several the shortest name, then the first. No row if none fits."""
    rank = F.coalesce(*(F.when(c, F.lit(i)) for i, c in enumerate(classes)))
    return names.withColumn("_class", rank).filter("_class is not null").orderBy("_class", F.char_length("name"), "name").limit(1).drop("_class")


def injection_folder(names: DataFrame, base: str, real_only: bool = False) -> DataFrame:
    """The folder (name, has_real) of an injection: hard and soft negatives before retrieval before any other that begins with the base.

    With real_only: those that hold real results, retrieval folders first; if none does, the shortest name of all.
    """
    name = F.col("name")
    hard = name.startswith(f"{base}_") & name.endswith("hard_soft_negative")
    found = name.startswith(f"{base}_") & name.endswith("retrieval")
    any_ = name.startswith(f"{base}_")
    real = F.col("has_real") & any_
    return first_match(names, [real & name.contains("retrieval"), real, any_] if real_only else [hard, found, any_])


def representation_file(names: DataFrame, representation: str, params: list[str]) -> DataFrame:
    """The file (name) of a representation: that of exactly these parameters, else the shortest that has all of them, else the bare one."""
    name, stem = F.col("name"), F.regexp_replace("name", r"\.jsonl$", "")
    exact = name == "_".join([representation, *params]) + ".jsonl"
    every = name.startswith(representation) & name.endswith(".jsonl")
    for p in params:
        every = every & F.contains(stem, F.lit(p))
    return first_match(names, [exact, every & F.lit(bool(params)), name == f"{representation}.jsonl"])


@F.pandas_udf(StructType([StructField("sha256", StringType()), StructField("lines", LongType())]))
def _unzipped(content: pd.Series) -> pd.DataFrame:
    def one(data):
        digest, lines, last = hashlib.sha256(), 0, b"\n"
        with gzip.open(io.BytesIO(data)) as f:
            while chunk := f.read(1 << 20):
                digest.update(chunk)
                lines, last = lines + chunk.count(b"\n"), chunk[-1:]
        return digest.hexdigest(), lines + (last != b"\n")

    return pd.DataFrame([one(x) for x in content], columns=["sha256", "lines"])


def gzip_contents(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, lines) of what each gzip file under a path holds, unpacked a megabyte at a time. A digest is sequential, so a file is one task's work."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), _unzipped("content").alias("c")).select("name", "c.*")


def results_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, as text columns; a byte-order mark before the first name is dropped. Compressed files read as they are."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("﻿").strip('"') for c in df.columns))


def prices(spark: SparkSession, path: str) -> DataFrame:
    """(model, rate_in, rate_out) from small YAML files of rates: models at two spaces, their fields at four."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    model = F.when(F.col("line").rlike(r"^  \S[^:]*:\s*$"), F.regexp_extract("line", r"^  (\S[^:]*):", 1))
    known = lines.withColumn("model", F.last(model, ignorenulls=True).over(Window.partitionBy("_file").orderBy("n")))
    field = lambda name: F.max(F.when(F.col("line").rlike(rf"^    {name}:"), F.regexp_extract("line", r":\s*([0-9.]+)", 1).cast("decimal(18,6)")))
    return known.filter("model is not null").groupBy("_file", "model").agg(field("input").alias("rate_in"), field("output").alias("rate_out")).drop("_file")


def resolve_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first of the names that the frame has."""
    return next((c for c in candidates if c in df.columns), None)


#: What a metric's column has in place of Avg where its standard error is meant.
ERROR_MARKS = ("SEM", "Sem", "sem", "_SEM", "_sem", " (SEM)", " (sem)")


def error_column(df: DataFrame, metric: str, itself: bool = True) -> str | None:
    """The column of a metric's standard error: its name with Avg exchanged for one of ERROR_MARKS, then with Score exchanged for NRR, then SEM(...) or sem(...) around it.

    A name without Avg is its own first candidate, so the metric itself is found; without
    ``itself`` it never is.
    """
    names = [metric.replace("Avg", mark) for mark in ERROR_MARKS] + [metric.replace("Score", "NRR"), f"SEM({metric})", f"sem({metric})"]
    return resolve_column(df, [n for n in names if itself or n != metric])

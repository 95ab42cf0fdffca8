"""Files in and out: JSON lines, whole texts with exact bytes, sidecars, checksums, reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.constraints import require_passed


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a stated schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_selections(df: DataFrame, path: str) -> None:
    """Gzipped JSON by dataset and method; Spark's commit makes each write whole or absent."""
    df.write.mode("overwrite").partitionBy("dataset", "method").option("compression", "gzip").json(path)


def read_texts(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """``example_id, context``: whole files by their exact bytes, so carriage returns stay."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.select(name.alias("example_id"), F.decode("content", "UTF-8").alias("context"))


def read_sidecars(spark: SparkSession, path: str, facts: T.StructType) -> DataFrame:
    """``example_id, ev_ord`` and a column per field of the annotated facts, one row per fact."""
    schema = T.StructType([T.StructField("support_facts", T.ArrayType(facts))])
    files = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("example_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return files.select("example_id", F.posexplode("support_facts").alias("ev_ord", "fact")).select("example_id", "ev_ord", "fact.*")


def read_exactly_one(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """``name, context`` of files whose path contains each name; none or several for a name raise."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).withColumn("name", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    found = names.join(files.select("name", "content"), "name", "left").groupBy("name").agg(F.count("content").alias("n"), F.first("content", ignorenulls=True).alias("content"))
    checked = F.when(F.col("n") == 1, F.decode("content", "UTF-8")).otherwise(F.raise_error(F.concat(F.lit("not exactly one file for "), F.col("name"))).cast("string"))
    return found.select("name", checked.alias("context"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``path, digest`` of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("digest"))


def write_csv(df: DataFrame, path: str) -> None:
    """A summary as one CSV file with a header; summaries are a row per cell."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def replace_json(value: object, path: str) -> None:
    """A driver-side summary, written beside its place and then renamed."""
    beside = f"{path}.tmp-{os.getpid()}"
    with open(beside, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(beside, path)


def small(df: DataFrame, most: int = 10_000) -> list:
    """All rows of a report. A frame of more than ``most`` rows is no report and is refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    return rows


def markdown(df: DataFrame) -> str:
    """A small report as a Markdown table."""
    rows = [tuple("-" if v is None else str(v) for v in r) for r in small(df)]
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)


def latex_rows(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """``row, line``: the lines of a pivoted LaTeX table; an incomplete cell is a dash."""
    wide = df.groupBy(row).pivot(column, columns).agg(F.first(value))
    cells = [F.coalesce(F.format_string("%.1f", F.bround(F.col(f"`{c}`").cast("double"), 1)), F.lit("--")) for c in columns]
    shown = [F.when(F.col(f"`{c}`").isNull(), F.lit("--")).otherwise(cell) for c, cell in zip(columns, cells, strict=True)]
    return wide.select(F.col(row), F.concat(F.concat_ws(" & ", F.col(row).cast("string"), *shown), F.lit(r" \\")).alias("line"))


def latex(df: DataFrame, row: str, column: str, value: str, columns: list[str], audits: DataFrame | None = None) -> str:
    """The whole table, ordered by row. With ``audits`` (rule, passed) it is refused as long as one of them has failed."""
    if audits is not None:
        require_passed(audits)
    lines = [r.line for r in small(latex_rows(df, row, column, value, columns).orderBy(row))]
    return "\n".join([rf"\begin{{tabular}}{{l{'r' * len(columns)}}}", *lines, r"\end{tabular}"])

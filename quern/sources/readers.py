"""Readers: tolerant JSON lines, polymorphic JSON, Q&A blocks, result pages; writers with quoting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ship import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; lines that don't parse are dropped, and a missing file is an empty one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_lines_checked(lines: DataFrame, schema: str, line: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """line, what is to be kept (say, a line's number), record, valid: not valid where the line doesn't parse; blank lines go."""
    record = F.from_json(F.col(line), f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return lines.where(F.trim(line) != "").select(F.col(line), *keep, record.alias("record")).withColumn("valid", F.col("record").isNotNull() & F.col("record._bad").isNull())


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their numbers (from 1) in their file: file, line, value, and the folder's partition columns. Spark splits files at line ends; lines are
    numbered within each split where they are read, and a prefix sum over the counts of a file's splits gives where each one begins."""
    lines = spark.read.text(path)
    rest = [c for c in lines.columns if c != "value"]
    placed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"), *rest)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}  # of the splits of this task
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            place = []
            for key in keys:
                place.append(seen.get(key, 0))
                seen[key] = place[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "place"])

    own = placed.mapInArrow(count, schema + ", place long")
    sizes = placed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return own.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("place") + 1).alias("line"), "value", *rest)


def json_items(c: Column) -> Column:
    """Items of a JSON document that is an array, an object with chunks, items or rows, or one object."""
    v = F.try_parse_json(c)
    many = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("chunks", "items", "rows")], F.try_variant_get(v, "$", "array<variant>"))
    return F.coalesce(many, F.when(v.isNotNull(), F.array(v)))


def qa_blocks(c: Column) -> Column:
    """Numbered question and answer blocks: (question, answer) structs."""
    blocks = F.filter(F.split(c, r"(?m)^\s*\d+[.)]\s+"), lambda b: F.trim(b) != "")
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.transform(blocks, lambda b: F.struct(bare(F.substring_index(b, "\n", 1)).alias("question"), bare(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2)).alias("answer")))


def links(html: Column) -> Column:
    """(url, title) of the anchors of a page, in order."""
    pattern = r'<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), 1).alias("url"), F.regexp_extract_all(html, F.lit(pattern), 2).alias("title"))
    return F.transform(both, lambda x: F.struct(x["url"].alias("url"), F.trim(F.regexp_replace(x["title"], "<[^>]+>", "")).alias("title")))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")


def write_csv(df: DataFrame, path: str) -> None:
    """All fields quoted, with a header."""
    df.write.mode("overwrite").option("quoteAll", True).option("header", True).csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def without_query(lines: DataFrame, query: str, line: str = "value", field: str = "query") -> DataFrame:
    """Log lines but those of one query; lines that don't parse stay as they are."""
    q = F.get_json_object(line, f"$.{field}")
    return lines.where(q.isNull() | (q != query))

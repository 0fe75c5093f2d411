"""Delimited files with line breaks inside quoted fields, read by many tasks.

A line break ends a record where the quotes before it in its file are even. Every split
counts its quotes; running sums of these few numbers give each split the state it
starts in, so all splits find their record ends on their own. Only a record that is
cut by the end of a split is put together from its pieces.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'
BROADCAST_SPLITS = 100_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, line``: lines in file order within a split, which starts at byte ``start``."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _quotes(line) -> F.Column:
    return F.length(line) - F.length(F.replace(line, F.lit(QUOTE), F.lit("")))


def splits_of(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, open``: splits with lines, and whether they start inside a quoted field.

    Fails, naming a file, when the quotes of a file do not pair up.
    """
    counted = _lines(spark, path).groupBy("file", "start").agg(F.sum(_quotes(F.col("line"))).alias("quotes"))
    odd = counted.groupBy("file").agg(F.sum("quotes").alias("quotes")).filter(F.col("quotes") % 2 == 1).first()
    if odd:
        raise ValueError(f"a quoted field does not end in {odd['file']}")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("file", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("open"))


def has_breaks(spark: SparkSession, path: str) -> bool:
    """Whether any line has an odd number of quotes, so that a field goes on in the next one."""
    return bool(_lines(spark, path).filter(_quotes(F.col("line")) % 2 == 1).head(1))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, first, record``: whole records as text; ``first`` marks the first record of a file."""
    states = splits_of(spark, path)
    lines = _lines(spark, path)
    if states.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        lines = lines.join(F.broadcast(states), ["file", "start"])  # lines stay where they are read
    else:
        order = F.monotonically_increasing_id()
        lines = lines.withColumn("order", order).join(states, ["file", "start"]).sortWithinPartitions("file", "start", "order")
    schema = "file string, start long, place long, whole boolean, text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records that begin in a split, and the rest of one that began before it (place -1)."""
        split, inside, place, held = None, False, -1, []

        def done(whole: bool) -> tuple:
            return (*split, place, whole, "\n".join(held))

        for batch in batches:
            out = []
            for file, start, line, starts_open in zip(*(batch[c].to_pylist() for c in ("file", "start", "line", "open"))):
                if (file, start) != split:
                    if held:
                        out.append(done(False))
                    split, inside, held = (file, start), starts_open, []
                    place = -1 if starts_open else 0
                held.append(line)
                inside ^= line.count(QUOTE) % 2 == 1
                if not inside:
                    out.append(done(place >= 0))
                    held, place = [], place + 1
            yield _batch(out)
        if held:
            yield _batch([done(False)])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds)], names=["file", "start", "place", "whole", "text"])

    pieces = lines.select("file", "start", "line", "open").mapInArrow(cut, schema)
    whole = pieces.filter("whole").select("file", ((F.col("start") == 0) & (F.col("place") == 0)).alias("first"), F.col("text").alias("record"))
    # A cut record is its beginning (place >= 0) and all pieces up to the next beginning: few, and as long as one record.
    cuts = pieces.filter(~F.col("whole"))
    number = F.sum(F.when(F.col("place") >= 0, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("start", F.col("place")))
    joined = cuts.withColumn("number", number).groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("start", "place", "text"))).alias("parts")
    )
    head = F.element_at("parts", 1)
    joined = joined.select("file", ((head["start"] == 0) & (head["place"] == 0)).alias("first"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("record"))
    return whole.unionByName(joined)


def read_quoted(spark: SparkSession, path: str, schema: T.StructType | None = None, *, sep: str = ",") -> DataFrame:
    """Columns of a delimited file or folder with headings; quotes are doubled inside quoted fields.

    Without a schema, columns are text and named by the headings of the first file. Empty
    fields are null; blank lines between records are passed over.
    """
    records = read_records(spark, path).withColumn("record", F.rtrim(F.col("record"), F.lit("\r")))
    if schema is None:
        headings = records.filter("first").orderBy("file").first()
        names = next(csv.reader(io.StringIO(headings["record"]), delimiter=sep)) if headings else []
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = records.filter(~F.col("first") & (F.col("record") != ""))
    options = {"sep": sep, "quote": QUOTE, "escape": QUOTE, "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    parsed = rows.select(F.from_csv("record", _ddl(schema), options).alias("r"))
    return parsed.select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)

"""Scoring whole texts on Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

BATCH_ROWS = 512


def score_texts(documents: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[list[str | None]], list[list]]], schema: str) -> DataFrame:
    """``doc_id`` and the columns of ``schema`` for every row, in place and without a shuffle.

    ``make`` runs once per task and returns a function from texts to columns.
    Every input row gives one row; a null text reaches the function as None.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    fields = _arrow_fields(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                columns = score(batch["text"].to_pylist())
                arrays = [pa.array(c, type=t) for c, (_, t) in zip(columns, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], names=["doc_id", *[n for n, _ in fields]])

    return rows.mapInArrow(run, f"doc_id {kind}, {schema}")


def _arrow_fields(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields]

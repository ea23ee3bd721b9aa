"""Reading tables of files that carry no types of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: What becomes of a row that does not fit the schema: an error, nulls in its cells, or none of it.
MALFORMED = {"fail": "FAILFAST", "null": "PERMISSIVE", "drop": "DROPMALFORMED"}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, malformed: str = "fail", separator: str = ",",
    infer_share: float = 1.0,
) -> DataFrame:
    """A CSV table whose first line names the columns.

    With a ``schema`` the files are read once, by need. Without, types are inferred, which takes
    one more pass over ``infer_share`` of the rows; a value that contradicts them later is
    malformed. Quoted fields may hold separators and line ends; empty fields are null.
    """
    if malformed not in MALFORMED:
        raise ValueError(f"malformed must be one of {sorted(MALFORMED)}")
    reader = spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("escape", '"').option("mode", MALFORMED[malformed])
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).option("samplingRatio", infer_share).csv(path)


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    """``df`` as CSV files with a header each; fields are quoted where they need it."""
    df.write.option("header", True).option("sep", separator).option("escape", '"').csv(path)

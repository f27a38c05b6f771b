"""Text tables in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                    encoding: str = "UTF-8", na_tokens: Sequence[str] = (),
                    multiline: bool = False) -> DataFrame:
    """CSV with every column a string; only an empty field is missing.

    ``na_tokens`` lists further spellings of a missing value, so that ``"NA"``
    stays a value unless asked for. ``multiline`` allows line breaks inside
    quotes, at the price of one task per file.
    """
    reader = (spark.read.option("header", True).option("encoding", encoding)
              .option("quote", '"').option("escape", '"').option("multiLine", multiline))
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path)
    if na_tokens:
        df = df.select(*[F.when(~F.col(c).isin(*na_tokens), F.col(c)).alias(c) for c in df.columns])
    return df


def read_typed_table(spark: SparkSession, path: str, schema: str | T.StructType,
                     date_format: str = "M/d/yyyy") -> DataFrame:
    """CSV with stated column types; text that does not fit becomes NULL."""
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("dateFormat", date_format).schema(schema).csv(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", encoding: str = "UTF-8") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("encoding", encoding).option(
            "quote", '"').option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)

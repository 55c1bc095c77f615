"""Table scans, sinks and schema checks."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table; projection and filters push down."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


CORRUPT = "_corrupt_record"


def _delimited(spark: SparkSession, path: str, sep: str, header: bool, names: Sequence[str] | None,
               prune: bool = True) -> DataFrame:
    """All columns of a delimited table as text, named by its header (or by ``names`` where it has none)."""
    read = spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
    found = read.csv(path).columns if header else list(names or [])
    fields = [T.StructField(c, T.StringType(), True) for c in [*found, CORRUPT]]
    # files whose header names other columns, or another order, are an error and not misread
    return read.option("columnPruning", prune).option("enforceSchema", not header).option("columnNameOfCorruptRecord", CORRUPT).schema(
        T.StructType(fields)).csv(path)


def read_delimited(spark: SparkSession, path: str, columns: Iterable[str],
                   sep: str = ",", header: bool = True) -> DataFrame:
    """The named columns of a delimited table, in the order given, every one read as text.

    With a header, columns are found by their name, whatever their place, and only the ones asked for are parsed; a name
    that the header lacks raises.  Without a header, ``columns`` names all columns by place.  No schema is inferred (it
    costs a pass and guesses differently per file); types are decided later with ``try_cast`` behind a numeric regex.
    """
    columns = list(columns)
    table = _delimited(spark, path, sep, header, columns).drop(CORRUPT)
    return require_columns(table, columns).select(*[F.col(f"`{c}`") for c in columns])


def malformed_rows(spark: SparkSession, path: str, sep: str = ",", columns: Iterable[str] = ()) -> DataFrame:
    """One row ``n_rows, n_malformed``: rows with too few or too many fields.  ``columns``: names, without a header."""
    names = list(columns)
    table = _delimited(spark, path, sep, not names, names, prune=False)  # all fields of a row must be parsed
    # the reader wants another column besides the corrupt record: the first field's count takes part in the total
    first = F.count(F.col(f"`{table.columns[0]}`"))
    return table.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(CORRUPT).isNotNull()).alias("n_malformed"),
                     first.alias("__first")).where("__first >= 0").select("n_rows", "n_malformed")


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """S3: raise with the available columns when a required one is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    """Column names by type family ('numeric', 'string', 'boolean')."""
    fams = {"numeric": T.NumericType, "string": T.StringType, "boolean": T.BooleanType}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, fams[kind])]


def find_column(df: DataFrame, *needles: str) -> str:
    """First column whose lower-cased name contains any needle."""
    for c in df.columns:
        if any(n.lower() in c.lower() for n in needles):
            return c
    raise ValueError(f"no column matches {needles}; available: {df.columns}")


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """CSV sink; written in parallel, one file per partition."""
    df.write.mode("overwrite").option("header", header).csv(path)


def write_json_summary(df: DataFrame, path: str) -> None:
    """JSON lines sink of a metric table."""
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Parquet sink (prediction tables, code maps, feature lists)."""
    df.write.mode("overwrite").parquet(path)


def run_metadata(df: DataFrame, **fields) -> DataFrame:
    """Attach literal run metadata and a wall-clock stamp to a summary."""
    cols = [F.lit(json.dumps(v) if isinstance(v, (list, dict)) else v).alias(k)
            for k, v in fields.items()]
    return df.select("*", *cols, F.current_timestamp().alias("run_ts"))

"""JSON and CSV output of posts and comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.functions import text as tx


def _flat(df: DataFrame, arrays_as_json: bool) -> DataFrame:
    """Timestamps as ISO text and, for formats without arrays, arrays as JSON text."""
    columns = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, T.TimestampNTZType):
            c = tx.iso_text(c)
        elif arrays_as_json and isinstance(field.dataType, T.ArrayType):
            c = F.to_json(c)
        columns.append(c.alias(field.name))
    return df.select(*columns)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, overwriting; fields that are null are written as null."""
    _flat(df, arrays_as_json=False).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, overwriting. Quotes are doubled; '' and null stay distinct, and so does white space at either end."""
    options = {
        "header": True, "quote": '"', "escape": '"', "emptyValue": '""', "nullValue": "",
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    }
    _flat(df, arrays_as_json=True).write.mode("overwrite").options(**options).csv(path)

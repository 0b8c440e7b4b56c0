"""Documents as JSON; absent fields are left out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_documents(docs: DataFrame, key: str) -> DataFrame:
    """``(key, json)``; NULL fields do not appear in the text."""
    return docs.select(key, F.to_json(F.struct(*docs.columns)).alias("json"))


def write_documents(docs: DataFrame, path: str) -> None:
    """One JSON document per line."""
    docs.write.option("ignoreNullFields", True).json(path)

"""Rows carried in one struct column, so that no name of theirs can clash with an operator's own."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "row"


def in_struct(docs: DataFrame) -> DataFrame:
    """The rows of `docs` as one column `row`."""
    return docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias(ROW))


def field(name: str) -> Column:
    return F.col(f"{ROW}.`{name}`")


def struct_schema(docs: DataFrame, more: str) -> T.StructType:
    """A schema of `row` and of the columns declared in `more`."""
    fields = [T.StructField(ROW, docs.schema, False), *T.StructType.fromDDL(more).fields]
    return T.StructType(fields)


def from_struct(rows: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of `docs` again. A new `text` takes the old one's place, and `n_chars`, where there
    is such a column, follows it."""
    out = []
    for c in docs.columns:
        value = field(c)
        if text is not None and c == "text":
            value = text
        elif text is not None and c == "n_chars":
            value = F.length(text).cast(docs.schema[c].dataType)
        out.append(value.alias(c))
    return rows.select(*out)

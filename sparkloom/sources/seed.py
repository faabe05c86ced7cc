"""Views seeded from the catalog: columns become dimensions, time groups and a count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns with fewer distinct values than this are searchable.
SEARCHABLE = 100


def semantic_type(kind: T.DataType) -> tuple[str, str | None]:
    """(type, datatype of a date) of a Spark type; what is unknown is a string."""
    if isinstance(kind, T.BooleanType):
        return "yesno", None
    if isinstance(kind, T.NumericType):
        return "number", None
    if isinstance(kind, T.DateType):
        return "time", "date"
    return ("time", "timestamp") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else ("string", None)


def cardinality(df: DataFrame) -> DataFrame:
    """Approximate distinct counts of the string columns, in one pass: column_name, n."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, n long")
    one = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(c) for c in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n")) for c in names])).alias("x")).select("x.*")


def view_of(df: DataFrame, name: str, table: str, model: str, comments: dict[str, str] | None = None) -> dict:
    """A view's definition of a table."""
    distinct = {r.column_name: r.n for r in cardinality(df).collect()}  # one row a column
    fields = []
    for f in df.schema:
        kind, datatype = semantic_type(f.dataType)
        d = {"name": f.name.lower(), "sql": f"${{TABLE}}.{f.name}"}
        if (comments or {}).get(f.name):
            d["description"] = comments[f.name]
        if kind == "time":
            d |= {"field_type": "dimension_group", "type": "time", "datatype": datatype, "timeframes": ["raw", "date", "week", "month", "quarter", "year"]}
        else:
            d |= {"field_type": "dimension", "type": kind}
            if kind == "string" and distinct.get(f.name, SEARCHABLE) < SEARCHABLE:
                d["searchable"] = True
        fields.append(d)
    fields.append({"name": "count", "field_type": "measure", "type": "count"})
    return {"type": "view", "name": name, "model_name": model, "sql_table_name": table, "fields": fields}


def seed(spark: SparkSession, model: str, database: str | None = None, table: str | None = None) -> list[dict]:
    """Definitions of all tables of a database, or of one."""
    found = [t for t in spark.catalog.listTables(database) if table in (None, t.name)]
    out = []
    for t in found:
        full = f"{database}.{t.name}" if database and not t.isTemporary else t.name
        comments = {c.name: c.description for c in spark.catalog.listColumns(full) if c.description}
        out.append(view_of(spark.table(full), t.name.lower(), full, model, comments))
    return out

"""CSV files as managed tables of an engine: types, a key, dense serial numbers, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators.gallery import numbered
from quillon.plans.engine import RID, TYPES, Engine

from .csv_table import CsvError, is_name, read_csv

LAYOUTS = ("HASH", "BPLUS", "BPLUS_CLUSTERED")
#: What the types of a CSV file are called in the dialect.
DIALECT = {"STRING": "VARCHAR"}


def import_csv(engine: Engine, path: str, table: str, layout: str = "HASH", key: str = "") -> dict:
    """Make a table of the rows at ``path``; what ``described`` tells of it.

    ``key`` names the column that the table is laid out by; without it, ``id`` is used, and
    made as dense numbers from 1 in the order of the files if there is none. A key may not
    be a POINT or TEXT, nor hold nulls, nor in BPLUS_CLUSTERED repeat a value: CsvError.
    """
    layout = layout.upper()
    if not is_name(table) or layout not in LAYOUTS:
        raise CsvError("a table takes a name and one of the layouts " + ", ".join(LAYOUTS))
    if any(t.lower() == table.lower() for t in engine.tables.names()):
        raise CsvError(f"there is a table {table} already")
    rows, kinds = read_csv(engine.spark, path)
    rows = rows.withColumn("_line", F.monotonically_increasing_id())
    if not key:
        key = "id"
        if "id" not in kinds:
            kinds = {"id": "INT"} | kinds
            rows = numbered(rows, "_line", "id").withColumn("id", F.col("id").cast("int"))
    if key not in kinds:
        raise CsvError(f"there is no column {key}")
    if kinds[key] in ("POINT", "TEXT"):
        raise CsvError(f"a key is no {kinds[key]}")
    if not rows.where(F.col(key).isNull()).isEmpty():
        raise CsvError(f"the key {key} is empty in some row")
    if layout == "BPLUS_CLUSTERED" and not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise CsvError(f"the key {key} repeats a value")
    columns = [{"name": n, "type": DIALECT.get(k, k), "size": None, "key": False, "required": False} for n, k in kinds.items()]
    done = engine.run({"kind": "create_table", "table": table, "columns": columns, "using": layout})
    if done.error:
        raise CsvError(done.error)
    made = engine.tables[table]
    kept = numbered(rows, "_line", RID)
    typed = kept.select(*[F.col(c["name"]).cast(TYPES[c["type"]]).alias(c["name"]) for c in columns], F.col(RID).cast("long").alias(RID))
    made.ordered_by = key  # by which rows are laid out; imported ones may repeat it
    engine.add_rows(made, typed, rows.count())
    engine.run({"kind": "create_index", "name": f"{table}_{key}", "table": table, "column": key, "method": "HASH" if layout == "HASH" else "BPLUS", "options": {}})
    for c in columns:
        if c["type"] == "TEXT":
            engine.run({"kind": "create_index", "name": f"{table}_{c['name']}_text", "table": table, "column": c["name"], "method": "FULLTEXT", "options": {}})
    engine.run({"kind": "analyze", "table": table})
    return engine.described(table)

"""Typed tables from CSV files with a header.

Types are found over all rows in one aggregation: POINT if every cell is one, else INT,
FLOAT, TEXT if a cell has over 32 bytes, STRING. Blank cells are null and fit every type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quillon.plans.dialect import NUMERAL

SIGNED = rf"^[+-]?{NUMERAL}$"
#: Numbers that no FLOAT holds: a column of them is refused, not read as text.
BOUNDLESS = ("nan", "inf", "infinity")
STRING_BYTES, FLOAT_MOST = 32, 3.4028234663852886e38
ROW = "_whole_row"


def is_name(text: str) -> bool:
    """Letters, digits and underscores of ASCII, no digit in front."""
    return text.isascii() and text.isidentifier()


class CsvError(ValueError):
    """The file can't become a table."""


def _reader(spark: SparkSession):
    return spark.read.option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8").option("emptyValue", "")


def _header(spark: SparkSession, path: str) -> list[str]:
    first = _reader(spark).option("header", False).csv(path).limit(1).collect()
    if not first:
        raise CsvError("the file is empty")
    names = [(c or "").lstrip("﻿").strip() for c in first[0]]
    bad = [n for n in names if not is_name(n)]
    if bad:
        raise CsvError(f"not a column name: {bad[0]!r}")
    if len(set(names)) < len(names):
        raise CsvError("a column name stands twice")
    return names


def _digits(cell: Column) -> Column:
    """A cell of groups of digits, parted by single underscores, without those; else null."""
    groups = F.split(F.regexp_replace(cell, "^[+-]", ""), "_")
    return F.when(F.forall(groups, lambda g: g.rlike("^[0-9]+$")), F.replace(cell, F.lit("_"), F.lit("")))


def _numbers_in_point(cell: Column) -> Column:
    """The two numbers of ``POINT(a b)`` or ``POINT(a, b)``, in any case, as texts; else null."""
    plain = F.upper(cell)
    inner = F.trim(F.regexp_extract(plain, r"^POINT\s*\((.*)\)$", 1))
    parts = F.split(inner, r"\s*[,\s]\s*")
    return F.when((F.size(parts) == 2) & F.forall(parts, lambda x: x.rlike(SIGNED)), parts)


def _fits(cell: Column) -> list[Column]:
    """Whether there is a value, and whether each type holds all values."""
    whole = lambda test: F.coalesce(F.every(F.when(cell.isNotNull(), test)), F.lit(True))
    boundless = F.lower(F.regexp_replace(cell, "^[+-]", "")).isin(*BOUNDLESS)
    return [F.count(cell) > 0, whole(_numbers_in_point(cell).isNotNull()), whole(_digits(cell).isNotNull()), whole(cell.rlike(SIGNED) | boundless), F.coalesce(F.max(F.octet_length(cell)), F.lit(0)) > STRING_BYTES]


def _kind(some: bool, point: bool, whole: bool, real: bool, long: bool) -> str:
    if not some:
        return "STRING"
    return "POINT" if point else "INT" if whole else "FLOAT" if real else "TEXT" if long else "STRING"


def _typed(cell: Column, kind: str) -> tuple[Column, Column]:
    """The value, and whether it is out of the type's range."""
    never = F.lit(False)
    if kind == "INT":
        wide = _digits(cell).try_cast("decimal(38,0)")
        return wide.try_cast("int"), cell.isNotNull() & (wide.isNull() | ~wide.between(-(2**31), 2**31 - 1))
    if kind == "FLOAT":
        value = cell.try_cast("double")
        return value.cast("float"), cell.isNotNull() & (value.isNull() | F.isnan(value) | (F.abs(value) > FLOAT_MOST))
    if kind == "POINT":
        lat, lon = (_numbers_in_point(cell)[i].try_cast("double") for i in (0, 1))
        infinite = F.greatest(F.abs(lat), F.abs(lon)) == float("inf")
        return F.when(cell.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"))), F.coalesce(infinite, never)
    return cell, never


def read_csv(spark: SparkSession, path: str, serial: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """The rows of the CSV files at ``path``, typed, and the type of each column.

    Cells are trimmed; blank cells are null; rows of blank cells only are skipped. ``serial``
    puts unique numbers in ascending file order in front, as ``id`` (not dense). No row, a
    row with another number of cells, a wrong header or a number out of range: CsvError.
    """
    names = _header(spark, path)
    if serial and "id" in names:
        raise CsvError("there is a column id already")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, ROW]])
    read = _reader(spark).schema(schema).option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", ROW).csv(path)
    cells = {n: F.when(F.trim(n) != "", F.trim(n)) for n in names}
    read = read.select(*[c.alias(n) for n, c in cells.items()], ROW).where(F.coalesce(*[F.col(n) for n in names]).isNotNull())
    found = read.agg(F.count("*").alias("rows"), F.min(ROW).alias("ragged"), *[F.array(*_fits(F.col(n))).alias(f"fits {n}") for n in names]).first()
    if not found["rows"]:
        raise CsvError("there is no row")
    if found["ragged"] is not None:
        raise CsvError(f"a row has another number of cells than the header: {found['ragged'][:80]!r}")
    kinds = {n: _kind(*found[f"fits {n}"]) for n in names}
    typed = {n: _typed(F.col(n), k) for n, k in kinds.items()}
    wrong = read.agg(*[F.min(F.when(bad, F.col(n))).alias(n) for n, (_, bad) in typed.items()]).first()
    for n in names:
        if wrong[n] is not None:
            raise CsvError(f"{wrong[n]!r} is out of range for {kinds[n]} in {n}")
    rows = read.select(*[v.alias(n) for n, (v, _) in typed.items()])
    if serial:
        rows = rows.select((F.monotonically_increasing_id() + 1).alias("id"), *names)
        kinds = {"id": "INT"} | kinds
    return rows, kinds

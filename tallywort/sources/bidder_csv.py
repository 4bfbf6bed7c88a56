"""The master CSV: 30 text columns, never coerced."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywort.functions.text import csv_cell
from tallywort.operators.schema import COLUMNS

MAX_BYTES = 20 * 2**20


def header_of(first_line: str) -> tuple[dict[str, str], list[str]]:
    """(column to header, ignored headers); an error if a column is missing. Headers match trimmed, in any case."""
    names = next(csv.reader(io.StringIO(first_line.removeprefix("﻿"))), [])
    by_name = {n.strip().casefold(): n for n in names}
    missing = [c for c in COLUMNS if c not in by_name]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return {c: by_name[c] for c in COLUMNS}, [n for k, n in by_name.items() if k not in COLUMNS]


def read_master_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows, skipped, warnings) of a master CSV: rows of a contractor with line; skipped rows, which have values but no
    contractor; warnings about ignored columns. Blank rows vanish. Cells keep their spaces and leading zeros.

    The file is small by contract (MAX_BYTES), so lines are numbered in one task; everything after is distributed.
    """
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError("the CSV is empty")
    header, ignored = header_of(first["value"])
    raw = spark.read.csv(
        path, header=True, inferSchema=False, multiLine=True, escape='"', encoding=encoding,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    if raw.columns and raw.columns[0].startswith("﻿"):
        raw = raw.withColumnRenamed(raw.columns[0], raw.columns[0].removeprefix("﻿"))
    cells = raw.coalesce(1).select((F.monotonically_increasing_id() + 2).alias("line"), *(csv_cell(F.col(f"`{h}`")).alias(c) for c, h in header.items()))
    some = cells.where(F.concat(*(F.col(c) for c in COLUMNS)) != "")
    warnings = ["ignored columns: " + ", ".join(ignored)] if ignored else []
    return some.where("contractor_name <> ''"), some.where("contractor_name = ''").select("line"), warnings


def write_csv(df: DataFrame, path: str) -> None:
    """Export of the business columns with cells safe for spreadsheets, as CSV part files with a header."""
    from tallywort.functions.text import spreadsheet_text

    df.select(*(spreadsheet_text(F.col(c)).alias(c) for c in COLUMNS)).write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    """Export of the business columns as they are, one JSON object a line."""
    df.select(*COLUMNS).write.json(path)

"""Text formats: CSV ledgers of any readable version, JSON-lines audit logs, import history, exports, ZIP archives."""

from __future__ import annotations

import csv
import hashlib
import re
import zipfile
from collections.abc import Sequence
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import neutralize_strings
from ..schema import LEDGER_COLUMNS, UNSUPPORTED, detect_version, encode_tags, normalize_ledger

AUDIT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("timestamp", "event", "command", "template_name", "template_domain", "param_fingerprint")]
    + [T.StructField("success", T.BooleanType()), T.StructField("duration", T.DoubleType()), T.StructField("_corrupt_record", T.StringType())]
)
IMPORT_COLUMNS = ("file_id", "original_filename", "imported_from", "archived", "archived_path", "imported_at", "source_rows")
ZIP_LIMITS = {"members": 32, "total": 100_000_000, "each": 50_000_000, "ratio": 100}


def read_ledger_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Ledger CSV files of versions 2 to 4, each read under its own header, as one typed table.

    Quotes inside fields are doubled, so JSON tag lists survive; all columns are read as text and then typed."""
    out: DataFrame | None = None
    for path in paths:
        raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
        if detect_version(raw.columns)[1] == UNSUPPORTED:
            raise ValueError(f"{path}: not a ledger of a known version")
        rows = normalize_ledger(raw)
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], normalize_schema())


def normalize_schema() -> T.StructType:
    from ..schema import LEDGER_SCHEMA

    return LEDGER_SCHEMA


def write_ledger_csv(df: DataFrame, path: str) -> None:
    options = {"header": True, "escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    encode_tags(df.select(*LEDGER_COLUMNS)).write.mode("overwrite").options(**options).csv(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed audit events; ``skipped_lines`` counts the others."""
    return _audit(spark, path).where("_corrupt_record is null").drop("_corrupt_record")


def skipped_lines(spark: SparkSession, path: str) -> int:
    return _audit(spark, path).where("_corrupt_record is not null").count()


def _audit(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return rows.select(F.from_json("value", AUDIT_SCHEMA, options).alias("e")).select("e.*")


def append_audit(events: DataFrame, path: str) -> None:
    events.drop("_corrupt_record").write.mode("append").json(path)


def trim_audit(events: DataFrame, keep: int = 100) -> DataFrame:
    """The newest events, in their order."""
    return events.orderBy(F.desc("timestamp")).limit(keep).orderBy("timestamp")


def file_id(path: str, taken: Sequence[str] = ()) -> str:
    """``YYMMDD_n`` from a date in the file's name, n counting up over those taken; else eight digits of the path's hash."""
    m = re.search(r"20(\d{2})[-_.]?(\d{2})[-_.]?(\d{2})", Path(path).name)
    if not m:
        return hashlib.sha256(path.encode()).hexdigest()[:8]
    day, n = "".join(m.groups()), 1
    while f"{day}_{n}" in taken:
        n += 1
    return f"{day}_{n}"


def list_imports(history: DataFrame) -> DataFrame:
    """All imports, the newest first."""
    return history.select(*IMPORT_COLUMNS).orderBy(F.desc("imported_at"), "file_id")


def find_import(history: DataFrame, file_id: str) -> dict[str, str | None] | None:
    """The entry of a file id, or None."""
    found = history.where(F.col("file_id") == file_id).select(*IMPORT_COLUMNS).first()
    return found.asDict() if found else None


def record_import(history: DataFrame, entry: DataFrame) -> DataFrame:
    """History with an entry, replacing that of the same source path; a file id of another path is refused."""
    clash = history.join(entry.select("file_id", F.col("imported_from").alias("__from")), "file_id").where("imported_from <> __from")
    if not clash.isEmpty():
        raise ValueError("file_id belongs to another file")
    return history.join(entry.select("imported_from"), "imported_from", "left_anti").select(*IMPORT_COLUMNS).unionByName(entry.select(*IMPORT_COLUMNS))


def export_master(df: DataFrame) -> DataFrame:
    """The fixed columns, tag lists as text, newest first, text safe for spreadsheets."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    out = df.withColumns({c: F.array_join(F.col(c), ", ") for c in arrays})
    cols = [c for c in LEDGER_COLUMNS if c in out.columns]
    return neutralize_strings(out.select(*cols)).orderBy(F.desc("date"), F.desc("time"), "row_hash")


def write_master(df: DataFrame, path: str) -> int:
    """The master export as a workbook; the number of rows."""
    from .workbook import write_workbook

    return write_workbook(export_master(df), path, "Master")


def write_report_csv(df: DataFrame, path: str) -> None:
    """A report as one CSV file on the driver, with a byte order mark, text safe for spreadsheets. Rows are written as they
    come, one partition at a time, and none is left out."""
    safe = neutralize_strings(df)
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows(safe.toLocalIterator())


def _shown(df: DataFrame, limit: int | None) -> tuple[list[Row], str]:
    """Rows to show, and a note where there are more."""
    if limit is None:
        return df.collect(), ""
    rows = df.limit(limit + 1).collect()
    return rows[:limit], f"only the first {limit} rows are shown" if len(rows) > limit else ""


def markdown_table(df: DataFrame, limit: int | None = 1000) -> str:
    """A table for a report; one cut at a limit says so."""
    rows, note = _shown(df, limit)
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = "| " + " | ".join(map(cell, df.columns)) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join(map(cell, r)) + " |\n" for r in rows) + (f"\n*{note}*\n" if note else "")


def html_table(df: DataFrame, limit: int | None = 1000) -> str:
    """A table for a report; one cut at a limit says so."""
    rows, note = _shown(df, limit)
    cell = lambda tag, v: f"<{tag}>{escape('' if v is None else str(v))}</{tag}>"
    lines = ["".join(cell("th", c) for c in df.columns), *["".join(cell("td", v) for v in r) for r in rows]]
    return "<table>" + (f"<caption>{note}</caption>" if note else "") + "".join(f"<tr>{r}</tr>" for r in lines) + "</table>"


def bar_chart(rows: Sequence[tuple[str, float]], title: str, width: int = 640) -> str:
    """Labels and amounts as an SVG of bars, for a report; negative amounts count by their size."""
    most = max((abs(v) for _, v in rows), default=0) or 1
    bars = "".join(
        f'<text x="0" y="{24 * k + 41}">{escape(str(name))}</text><rect x="160" y="{24 * k + 28}" width="{round((width - 260) * abs(v) / most, 1)}" height="16"/>'
        f'<text x="{round(166 + (width - 260) * abs(v) / most, 1)}" y="{24 * k + 41}">{abs(v):,.0f}</text>'
        for k, (name, v) in enumerate(rows)
    )
    none = "" if rows else '<text x="0" y="41">no data</text>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{24 * max(1, len(rows)) + 30}" role="img"><title>{escape(title)}</title><text x="0" y="16">{escape(title)}</text>{bars}{none}</svg>'


def line_chart(rows: Sequence[tuple[str, float]], title: str, width: int = 640, height: int = 240) -> str:
    """Periods and amounts as an SVG line with a mark a period, in the order given."""
    most = max((abs(v) for _, v in rows), default=0) or 1
    step = (width - 40) / max(1, len(rows) - 1)
    points = [(round(20 + k * step, 1), round(height - 30 - (height - 70) * abs(v) / most, 1)) for k, (_, v) in enumerate(rows)]
    marks = "".join(f'<circle cx="{x}" cy="{y}" r="3"><title>{escape(str(n))}: {abs(v):,.0f}</title></circle>' for (x, y), (n, v) in zip(points, rows))
    ends = "".join(f'<text x="{points[k][0]}" y="{height - 8}" text-anchor="{a}">{escape(str(rows[k][0]))}</text>' for k, a in ((0, "start"), (-1, "end"))) if rows else '<text x="20" y="60">no data</text>'
    path = " ".join(f"{x},{y}" for x, y in points)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" role="img"><title>{escape(title)}</title><text x="20" y="20">{escape(title)}</text><polyline fill="none" stroke="currentColor" points="{path}"/>{marks}{ends}</svg>'


def extract_zip(path: str, target: str, suffix: str = ".xlsx") -> list[str]:
    """Members of an archive with a suffix, within limits of number, sizes and compression, and only below the target."""
    out, total = [], 0
    with zipfile.ZipFile(path) as z:
        members = [m for m in z.infolist() if not m.is_dir()]
        if len(members) > ZIP_LIMITS["members"]:
            raise ValueError("too many members")
        for m in members:
            total += m.file_size
            if m.file_size > ZIP_LIMITS["each"] or total > ZIP_LIMITS["total"] or m.file_size > ZIP_LIMITS["ratio"] * max(1, m.compress_size):
                raise ValueError(f"{m.filename}: over the limits")
            name = Path(m.filename)
            if name.is_absolute() or ".." in name.parts:
                raise ValueError(f"{m.filename}: outside the archive")
            if name.suffix.lower() == suffix:
                to = Path(target) / name.name
                to.write_bytes(z.read(m))
                out.append(str(to))
    return out

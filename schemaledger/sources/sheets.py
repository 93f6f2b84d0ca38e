"""Export sink: one dataset folder per sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_sheets(sheets: dict[str, DataFrame], path: str, file_format: str = "parquet") -> list[str]:
    """Write every sheet below ``path``; returns the folders."""
    folders = []
    for name, rows in sheets.items():
        folder = f"{path.rstrip('/')}/{name.lower().replace(' ', '_')}"
        writer = rows.write.mode("errorifexists")
        (writer.option("header", "true") if file_format == "csv" else writer).format(file_format).save(folder)
        folders.append(folder)
    return folders

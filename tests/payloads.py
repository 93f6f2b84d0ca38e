"""Small hand-made snapshots."""

import datetime as dt
import json

from schemaledger.sources import documents

AT = dt.datetime(2024, 5, 1, 12, 0, 0)


def part(snapshot_id, payload, source_id=1, at=AT):
    text = payload if isinstance(payload, str) else json.dumps(payload)
    return (snapshot_id, source_id, snapshot_id + 10, at, text)


def parts(spark, *rows):
    """Rows of the store, read from documents."""
    shape = "snapshot_id BIGINT, data_source_id BIGINT, run_id BIGINT, captured_at TIMESTAMP_NTZ, payload STRING"
    return documents.from_documents(spark.createDataFrame(list(rows), shape))


def column(name, type_="integer", **more):
    return {"name": name, "type": type_, "nullable": True, "default": None, "comment": None, **more}


def table(name, *columns, **more):
    return {"name": name, "columns": list(columns), "indexes": [], "foreign_keys": [], **more}


def payload(*tables, schema="public", **more):
    return {
        "source": "shop", "db_type": "postgresql", "database": "db",
        "schemas": [{"name": schema, "tables": list(tables), "views": [], "procedures": []}], "skipped_schemas": [], **more,
    }

"""Reader options of the eight database kinds."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Mapping
from typing import Any

from .. import model

# JDBC driver classes and URL forms of the public drivers.
_JDBC = {
    "postgresql": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}"),
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}"),
    "mariadb": ("org.mariadb.jdbc.Driver", "jdbc:mariadb://{host}:{port}/{database}"),
    "mssql": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://{host}:{port};databaseName={database}"),
    "oracle": ("oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@//{host}:{port}/{service}"),
    "sqlite": ("org.sqlite.JDBC", "jdbc:sqlite:{database}"),
    "db2": ("com.ibm.db2.jcc.DB2Driver", "jdbc:db2://{host}:{port}/{database}"),
}
_TLS_POSTGRESQL = {"ca": "sslrootcert", "cert": "sslcert", "key": "sslkey"}
_TLS_MARIADB = {"ca": "serverSslCert", "cert": "clientCertificateKeyStoreUrl", "key": "clientCertificateKeyStorePassword"}
FETCH_ROWS = 10_000


def reader_format(source: Mapping[str, Any]) -> str:
    return "bigquery" if source["db_type"] == "bigquery" else "jdbc"


def _check(source: Mapping[str, Any], mode: str) -> str:
    kind = source["db_type"]
    if kind not in model.DB_TYPES or kind in model.EXCLUDED_DB_TYPES.get(mode, ()):
        raise ValueError(f"unsupported database kind: {kind}")
    return kind


def _bigquery(source: Mapping[str, Any]) -> dict[str, str]:
    options = source.get("options") or {}
    account = source.get("service_account")
    if not account:
        raise ValueError("a BigQuery source needs a service account")
    location = str(options.get("location", "US"))
    if not re.fullmatch(model.BIGQUERY_PROJECT, source["database"]) or not re.fullmatch(model.BIGQUERY_REGION, location.lower()):
        raise ValueError("malformed BigQuery project or region")
    read = {
        "parentProject": source["database"],
        "credentials": base64.b64encode(json.dumps(account).encode()).decode(),
        "location": location,
        "viewsEnabled": "true",
    }
    if options.get("dataset"):
        read["dataset"] = options["dataset"]
        read["materializationDataset"] = options["dataset"]
    return read


def jdbc_options(source: Mapping[str, Any], mode: str = "local") -> dict[str, str]:
    """Options for ``spark.read.format(reader_format(source))``.

    User and password are options, never part of the URL. Certificates are given as paths every executor can read
    (``ssl_ca_path``, ``ssl_cert_path``, ``ssl_key_path``).
    """
    kind = _check(source, mode)
    if kind == "bigquery":
        return _bigquery(source)
    options = source.get("options") or {}
    driver, form = _JDBC[kind]
    database = source.get("database") or ""
    url = form.format(
        host=source.get("host") or "localhost",
        port=source.get("port") or model.DEFAULT_PORTS.get(kind, ""),
        database=database,
        service=options.get("service_name") or database,
    )
    read = {"url": url, "driver": driver, "fetchsize": str(FETCH_ROWS)}
    if kind != "sqlite":
        read["user"], read["password"] = source.get("username") or "", source.get("password") or ""
    if kind == "mssql":
        read["encrypt"], read["trustServerCertificate"] = "true", "true"
    if options.get("ssl_enabled"):
        paths = {label: source.get(f"ssl_{label}_path") for label in ("ca", "cert", "key")}
        given = {label: path for label, path in paths.items() if path}
        if kind == "postgresql":
            read["sslmode"] = "require"
            read.update({_TLS_POSTGRESQL[label]: path for label, path in given.items()})
        elif kind == "mysql":
            read["sslMode"] = "VERIFY_CA" if "ca" in given else "REQUIRED"
            if "ca" in given:
                read["trustCertificateKeyStoreUrl"] = f"file:{given['ca']}"
            if "cert" in given:
                read["clientCertificateKeyStoreUrl"] = f"file:{given['cert']}"
        elif kind == "mariadb":
            read["sslMode"] = "verify-ca" if "ca" in given else "trust"
            read.update({_TLS_MARIADB[label]: path for label, path in given.items() if label != "key"})
    read.update({key: str(value) for key, value in (options.get("connect_args") or {}).items()})
    return read

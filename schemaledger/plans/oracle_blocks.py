"""SQL blocks of the driver-table projection, shared by the oracle statements."""

from __future__ import annotations

from .. import model


def rounded(value: str) -> str:
    """A double rounded to two digits on its exact binary value, ties to even."""
    unit = 2**60
    fraction = f"(CAST((abs({value}) - floor(abs({value}))) * {float(unit)!r} AS HUGEINT) * 100)"
    up = f"CASE WHEN {fraction} % {unit} * 2 > {unit} OR ({fraction} % {unit} * 2 = {unit} AND {fraction} // {unit} % 2 = 1) THEN 1 ELSE 0 END"
    return f"(sign({value}) * (CAST(CAST(floor(abs({value})) AS BIGINT) * 100 + {fraction} // {unit} + {up} AS DOUBLE) / 100))"


def _words(digest: str) -> str:
    """Sums of the eight 32-bit words of hex digests, as hex numbers with commas."""
    return "concat_ws(',', " + ", ".join(f"format('{{:x}}', CAST(sum(CAST('0x' || substr({digest}, {k * 8 + 1}, 8) AS BIGINT)) AS BIGINT))" for k in range(8)) + ")"


_TABLE = "data_source_id, yr, snapshot_id, captured_on, schema_name, table_name"

BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "p1_sources": ((), """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
               CASE n_nationkey % 8 WHEN 0 THEN 'postgresql' WHEN 1 THEN 'mysql' WHEN 2 THEN 'mariadb' WHEN 3 THEN 'mssql'
                    WHEN 4 THEN 'oracle' WHEN 5 THEN 'sqlite' WHEN 6 THEN 'db2' ELSE 'bigquery' END AS db_type,
               concat(lower(n_name), '.db.example') AS host, r_name AS database_name,
               CASE n_nationkey % 3 WHEN 0 THEN 'connected' WHEN 1 THEN 'failed' ELSE 'unchecked' END AS status
        FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "p1_columns": ((), """
        SELECT CAST(c_nationkey AS BIGINT) AS data_source_id, CAST(year(o_orderdate) AS INT) AS yr,
               CAST(c_nationkey AS BIGINT) * 10000 + CAST(year(o_orderdate) AS BIGINT) AS snapshot_id,
               make_date(CAST(year(o_orderdate) AS INT), 12, 31) AS captured_on,
               c_mktsegment AS schema_name, c_name AS table_name, o_orderpriority AS column_name,
               concat('decimal(', CAST(count(*) AS VARCHAR), ')') AS data_type, count(*) > 1 AS nullable,
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS data_bytes
        FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY c_nationkey, year(o_orderdate), c_mktsegment, c_name, o_orderpriority"""),
    "p1_tables": (("p1_columns",), f"""
        SELECT {_TABLE}, CAST(count(*) AS BIGINT) AS column_count, CAST(sum(data_bytes) AS BIGINT) AS data_bytes,
               CAST(count(*) * 8192 AS BIGINT) AS index_bytes, CAST(sum(data_bytes) + count(*) * 8192 AS BIGINT) AS total_bytes,
               CASE WHEN count(*) > 1 THEN CAST(count(*) AS BIGINT) END AS row_estimate
        FROM p1_columns GROUP BY {_TABLE}"""),
    "p1_snapshots": (("p1_columns",), """
        SELECT DISTINCT snapshot_id AS id, data_source_id, snapshot_id + 10 AS run_id, captured_on, yr FROM p1_columns"""),
    "p1_indexes": ((), """
        SELECT CAST(c_nationkey AS BIGINT) * 10000 + CAST(year(o_orderdate) AS BIGINT) AS snapshot_id, c_mktsegment AS schema_name,
               c_name AS table_name, concat('ix_', lower(o_orderstatus)) AS index_name, count(*) = 1 AS is_unique,
               min(o_orderpriority) AS first_column, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS column_count
        FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY c_nationkey, year(o_orderdate), c_mktsegment, c_name, o_orderstatus"""),
    "p1_views": (("p1_columns",), """
        SELECT snapshot_id, schema_name, concat('v_', substr(column_name, 1, 1)) AS name,
               concat('SELECT * FROM ', min(table_name)) AS definition
        FROM p1_columns GROUP BY snapshot_id, schema_name, substr(column_name, 1, 1)"""),
    "p1_routines": (("p1_columns",), """
        SELECT snapshot_id, schema_name, concat('p_', substr(column_name, 1, 1)) AS name, substr(column_name, 1, 1) AS digit,
               concat('SELECT * FROM ', min(table_name)) AS definition
        FROM p1_columns GROUP BY snapshot_id, schema_name, substr(column_name, 1, 1)"""),
    "p1_routine_lines": (("p1_columns",), """
        SELECT snapshot_id, schema_name, concat('p_', substr(column_name, 1, 1)) AS name, substr(column_name, 1, 1) AS digit,
               row_number() OVER (PARTITION BY snapshot_id, schema_name, substr(column_name, 1, 1) ORDER BY table_name) AS line,
               concat('line ', table_name) AS text
        FROM p1_columns"""),
    "p1_grants": ((), """
        SELECT CAST(c_nationkey AS BIGINT) AS data_source_id, c_mktsegment AS schema_name, c_name AS table_name, c_custkey AS k
        FROM customer WHERE c_acctbal > 0"""),
    "p1_permissions": (("p1_tables", "p1_grants"), """
        SELECT t.snapshot_id, t.schema_name, t.table_name, g.table_name IS NOT NULL OR t.schema_name = 'MACHINERY' AS granted,
               CASE WHEN g.table_name IS NOT NULL THEN 'reader' WHEN t.schema_name = 'MACHINERY' THEN 'current_user'
                    ELSE 'not_collected' END AS checked_as
        FROM p1_tables t LEFT JOIN p1_grants g
          ON g.data_source_id = t.data_source_id AND g.schema_name = t.schema_name AND g.table_name = t.table_name"""),
    "p1_runs": ((), """
        SELECT event_id AS id, user_id AS job_id, ts AS started_at,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'success' END AS status,
               CAST(floor(value) AS BIGINT) AS object_count, CASE WHEN event_type = 'error' THEN props END AS error_message
        FROM events"""),
    "p1_jobs": ((), """
        SELECT DISTINCT user_id AS id, concat('job ', CAST(user_id AS VARCHAR)) AS name,
               CASE WHEN user_id % 7 = 0 THEN user_id + 1000 ELSE user_id % 25 END AS data_source_id,
               CASE user_id % 3 WHEN 0 THEN 'cron' WHEN 1 THEN 'interval' ELSE 'manual' END AS schedule_type,
               CASE WHEN user_id % 3 = 1 AND user_id % 2 = 0 THEN CAST(user_id AS INT) END AS interval_minutes,
               user_id % 4 <> 0 AS is_active
        FROM events"""),
    "p1_user_roles": ((), """
        SELECT DISTINCT o_custkey AS user_id, concat('role_', o_orderstatus) AS role_name FROM orders"""),
    "p1_role_permissions": ((), """
        SELECT DISTINCT concat('role_', o_orderstatus) AS role_name,
               CASE WHEN o_orderstatus = 'P' AND substr(o_orderpriority, 1, 1) = '1' THEN 'admin:*'
                    ELSE concat('perm:', substr(o_orderpriority, 1, 1)) END AS code
        FROM orders WHERE o_orderstatus = 'P' OR (ascii(substr(o_orderpriority, 1, 1)) + ascii(o_orderstatus)) % 2 = 0"""),
    "p1_role_menus": ((), """
        SELECT DISTINCT concat('role_', o_orderstatus) AS role_name,
               concat('menu_', CAST(year(o_orderdate) % 10 AS VARCHAR)) AS menu_code
        FROM orders WHERE o_totalprice > 400000"""),
    "p1_stored": ((), """
        SELECT concat('name ', CAST(c_custkey AS VARCHAR)) AS name, c_acctbal AS val FROM customer WHERE c_custkey % 2 = 0
        UNION ALL
        SELECT concat('name ', CAST(c_custkey AS VARCHAR), ' (2)') AS name, c_acctbal AS val FROM customer WHERE c_custkey % 12 = 0"""),
    "p1_incoming": ((), """
        SELECT c_custkey * 2 AS row_no, concat('name ', CAST(c_custkey AS VARCHAR)) AS name, c_acctbal + 1 AS val
        FROM customer WHERE c_custkey % 3 = 0
        UNION ALL
        SELECT c_custkey * 2 + 1 AS row_no, concat('name ', CAST(c_custkey AS VARCHAR)) AS name, c_acctbal + 2 AS val
        FROM customer WHERE c_custkey % 9 = 0"""),
    "p1_connections": ((), """
        SELECT c_custkey AS id, c_name AS name,
               CASE c_custkey % 9 WHEN 0 THEN 'postgresql' WHEN 1 THEN 'mysql' WHEN 2 THEN 'mariadb' WHEN 3 THEN 'mssql'
                    WHEN 4 THEN 'oracle' WHEN 5 THEN 'sqlite' WHEN 6 THEN 'db2' WHEN 7 THEN 'bigquery' ELSE 'access' END AS db_type,
               CASE WHEN c_custkey % 11 <> 0 THEN concat(lower(c_mktsegment), '.db.example') END AS host,
               CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 9000 + 1000 AS INT) END AS port,
               concat('DB_', CAST(c_nationkey AS VARCHAR)) AS "database",
               CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'reader' END AS username,
               CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN NULL ELSE concat('pw', CAST(c_custkey AS VARCHAR)) END AS password,
               CASE WHEN c_custkey % 7 = 0 THEN concat('key', CAST(c_custkey AS VARCHAR)) END AS ssh_private_key,
               c_custkey % 6 = 0 AS ssh_enabled, c_custkey % 9 = 0 AS ssh_nested_enabled, c_custkey % 2 = 0 AS ssl_enabled,
               CASE WHEN c_custkey % 8 = 0 THEN concat('ca', CAST(c_custkey AS VARCHAR)) END AS ssl_ca_cert,
               CASE c_custkey % 3 WHEN 0 THEN 'connected' WHEN 1 THEN 'failed' ELSE 'unchecked' END AS status,
               c_acctbal AS val, c_nationkey, c_mktsegment
        FROM customer"""),
    # previous snapshot of each snapshot, and table growth against it
    "p1_previous": (("p1_snapshots",), """
        SELECT id AS snapshot_id, lag(id) OVER (PARTITION BY data_source_id ORDER BY captured_on, id) AS previous_id
        FROM p1_snapshots"""),
    "p1_growth": (("p1_tables", "p1_previous"), """
        SELECT t.*, o.total_bytes AS previous_total_bytes, t.total_bytes - o.total_bytes AS growth_bytes,
               CASE WHEN o.total_bytes <> 0 THEN """ + rounded(
        "(CAST(t.total_bytes - o.total_bytes AS DOUBLE) / CAST(o.total_bytes AS DOUBLE) * 100)") + """ END AS growth_percent
        FROM p1_tables t JOIN p1_previous p ON p.snapshot_id = t.snapshot_id
        LEFT JOIN p1_tables o ON o.snapshot_id = p.previous_id AND o.schema_name = t.schema_name AND o.table_name = t.table_name"""),
    "p1_foreign_keys": (("p1_columns",), """
        SELECT snapshot_id, schema_name, table_name, concat('fk_', substr(column_name, 1, 1)) AS key_name, column_name
        FROM p1_columns WHERE data_bytes % 3 = 0"""),
    # canonical value of every table, view and routine, growth left out; tables also in parts
    "p1_values": (("p1_columns", "p1_tables", "p1_indexes", "p1_foreign_keys", "p1_permissions", "p1_views", "p1_routines"), """
        SELECT snapshot_id, 'table' AS kind, schema_name, table_name AS name,
               concat('{"columns":[', columns, '],', own, ',"indexes":[', coalesce(indexes, ''), ']', tail, ',"storage":{"data_bytes":', data_bytes, ',"index_bytes":', index_bytes,
                      ',"row_estimate":', coalesce(CAST(row_estimate AS VARCHAR), 'null'), ',"total_bytes":', total_bytes, '},"unique_constraints":[]}') AS value,
               concat('{', own, tail, ',"unique_constraints":[]}') AS own_value
        FROM (SELECT t.*, c.columns, i.indexes, concat('"comment":"about ', table_name, '","foreign_keys":[', coalesce(f.keys, ''), ']') AS own,
                     concat(',"name":"', table_name, '","permissions":{"checked_as":"', checked_as, '","privileges":[', CASE WHEN granted THEN '"SELECT"' ELSE '' END, '],"select":',
                            CASE WHEN granted THEN 'true' ELSE 'null' END, '},"primary_key":{"constrained_columns":[', c.pk, '],"name":null}') AS tail
              FROM p1_tables t JOIN p1_permissions USING (snapshot_id, schema_name, table_name)
              JOIN (SELECT snapshot_id, schema_name, table_name, CASE WHEN count(*) > 1 THEN concat('"', min(column_name), '"') ELSE '' END AS pk,
                      string_agg(concat('{"comment":null,"default":null,"name":"', column_name, '","nullable":', nullable, ',"type":"', data_type, '"}'), ',' ORDER BY column_name) AS columns
                    FROM p1_columns GROUP BY ALL) c USING (snapshot_id, schema_name, table_name)
              LEFT JOIN (SELECT snapshot_id, schema_name, table_name, string_agg(concat('{"column_names":["', first_column, CASE WHEN column_count > 1 THEN '","…"' ELSE '",null' END,
                      '],"name":"', index_name, '","unique":', is_unique, '}'), ',' ORDER BY index_name) AS indexes FROM p1_indexes GROUP BY ALL) i USING (snapshot_id, schema_name, table_name)
              LEFT JOIN (SELECT snapshot_id, schema_name, table_name, string_agg(concat('{"constrained_columns":["', column_name, '"],"name":"', key_name, '","referred_columns":["', column_name,
                      '",null],"referred_schema":"', schema_name, '","referred_table":"ref_', substr(column_name, 1, 1), '"}'), ',' ORDER BY key_name) AS keys FROM p1_foreign_keys GROUP BY ALL) f
                USING (snapshot_id, schema_name, table_name))
        UNION ALL SELECT snapshot_id, 'view', schema_name, name, value, value FROM (SELECT *, concat('{"definition":"', definition, '","name":"', name, '","permissions":', CASE WHEN schema_name = 'MACHINERY'
               THEN '{"checked_as":"current_user","privileges":["SELECT"],"select":true}' ELSE '{"checked_as":"not_collected","privileges":[],"select":null}' END, '}') AS value FROM p1_views)
        UNION ALL SELECT snapshot_id, 'procedure', schema_name, name, value, value FROM (SELECT *,
               concat('{"arguments":null,"definition":"', definition, '","name":"', name, '","return_type":null,"routine_type":"PROCEDURE"}') AS value FROM p1_routines)"""),
    # digests of snapshots from those of their facts, schemas and objects
    "p1_fingerprints": (("p1_values", "p1_snapshots", "p1_sources", "p1_tables"), """
        SELECT s.id AS snapshot_id, s.data_source_id, sha256(concat_ws(',', sha256(concat('{"source":"', d.name, '","db_type":"', d.db_type, '","database":"', d.database_name,
               '","collection_options":{"items":[', """ + "'" + ",".join(f'"{i}"' for i in sorted(model.DEFAULT_ITEMS)) + "'" + """, '],"storage_growth":true},"skipped_schemas":[]}')), n.words, o.words)) AS fingerprint
        FROM p1_snapshots s JOIN p1_sources d ON d.id = s.data_source_id
        JOIN (SELECT snapshot_id, """ + _words("digest") + """ AS words FROM (SELECT DISTINCT snapshot_id, sha256(schema_name) AS digest FROM p1_tables) GROUP BY snapshot_id) n ON n.snapshot_id = s.id
        JOIN (SELECT snapshot_id, """ + _words("digest") + """ AS words FROM (SELECT snapshot_id, sha256(CAST(to_json([kind, schema_name, value]) AS VARCHAR)) AS digest FROM p1_values)
              GROUP BY snapshot_id) o ON o.snapshot_id = s.id"""),
    # objects with the value text that the diff compares
    "p1_objects": (("p1_columns",), """
        SELECT data_source_id, yr, snapshot_id, 'column' AS kind, schema_name, table_name, column_name AS name,
               concat('column:', schema_name, '.', table_name, '.', column_name) AS "key",
               concat('{"comment":null,"default":null,"name":"', column_name, '","nullable":',
                      CASE WHEN nullable THEN 'true' ELSE 'false' END, ',"type":"', data_type, '"}') AS value
        FROM p1_columns"""),
}


def with_blocks(needs: tuple[str, ...], body: str) -> str:
    """The statement with the blocks it needs, each after the blocks it builds on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for before in BLOCKS[name][0]:
            add(before)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(f"{name} AS ({BLOCKS[name][1]})" for name in ordered)
    return f"WITH {ctes}\n{body.strip()}"  # a body that starts with a comma adds blocks of its own

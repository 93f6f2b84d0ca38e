"""Queries over users, roles, permissions and menus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access
from . import driver_tables as p1
from .registry import query


def _access(spark, sf):
    return access.effective_access(p1.user_roles(spark, sf), p1.role_permissions(spark, sf), p1.role_menus(spark, sf))


@query("c10_user_permissions", "p1_user_roles", "p1_role_permissions", sql="""
    SELECT user_id, code FROM p1_user_roles JOIN p1_role_permissions USING (role_name)""")
def user_permissions(spark, sf):
    return access.user_permissions(p1.user_roles(spark, sf), p1.role_permissions(spark, sf))


@query("d8_effective_access", "p1_user_roles", "p1_role_permissions", "p1_role_menus", sql="""
    SELECT user_id, string_agg(DISTINCT role_name, ',' ORDER BY role_name) AS roles,
           (SELECT string_agg(DISTINCT code, ',' ORDER BY code) FROM p1_user_roles r JOIN p1_role_permissions USING (role_name)
             WHERE r.user_id = u.user_id) AS permissions,
           (SELECT count(*) FROM p1_user_roles r JOIN p1_role_menus USING (role_name) WHERE r.user_id = u.user_id) AS menu_count
    FROM p1_user_roles u GROUP BY user_id""")
def effective_access(spark, sf):
    return _access(spark, sf).select(
        "user_id", F.array_join("roles", ",").alias("roles"), F.array_join("permissions", ",").alias("permissions"),
        F.size("menus").cast("bigint").alias("menu_count"),
    )


@query("d8_effective_menus", "p1_user_roles", sql="""
    , menus AS (SELECT DISTINCT concat('role_', o_orderstatus) AS role_name, concat('menu_', CAST(year(o_orderdate) AS VARCHAR), '_',
                       substr(o_orderpriority, 1, 1)) AS menu_code FROM orders)
    SELECT user_id, string_agg(menu_code, ',' ORDER BY role_name, menu_code) AS menus
    FROM p1_user_roles JOIN menus USING (role_name) GROUP BY user_id""")
def effective_menus(spark, sf):
    """The menus of every user in their order, repeats of several roles kept; menus come from all orders."""
    menu = F.concat(F.lit("menu_"), F.year("o_orderdate").cast("string"), F.lit("_"), F.substring("o_orderpriority", 1, 1))
    menus = p1.table(spark, sf, "orders").select(F.concat(F.lit("role_"), "o_orderstatus").alias("role_name"), menu.alias("menu_code")).distinct()
    rows = access.effective_access(p1.user_roles(spark, sf), p1.role_permissions(spark, sf), menus)
    return rows.select("user_id", F.array_join("menus", ",").alias("menus"))


@query("d9_permission_check", "p1_user_roles", "p1_role_permissions", sql="""
    SELECT user_id, bool_or(coalesce(code IN ('admin:*', 'perm:2'), false)) AS allowed
    FROM p1_user_roles LEFT JOIN p1_role_permissions USING (role_name) GROUP BY user_id""")
def permission_check(spark, sf):
    return access.permission_check(p1.user_roles(spark, sf), p1.role_permissions(spark, sf), "perm:2")


@query("d9_users_allowed", "p1_user_roles", "p1_role_permissions", sql="""
    SELECT DISTINCT user_id FROM p1_user_roles JOIN p1_role_permissions USING (role_name) WHERE code IN ('admin:*', 'perm:1')""")
def users_allowed(spark, sf):
    return access.users_allowed(p1.user_roles(spark, sf), p1.role_permissions(spark, sf), "perm:1")


@query("c11_roles_by_ids", sql="""
    SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN
      (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_custkey + 1 FROM orders WHERE o_orderstatus = 'P')""")
def roles_by_ids(spark, sf):
    requests = p1.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(
        F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("ids")
    )
    roles = p1.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return access.attributes_by_ids(requests, roles)


@query("d12_role_cards", "p1_role_permissions", "p1_role_menus", sql="""
    SELECT role_name, count(*) AS permission_count, (SELECT count(*) FROM p1_role_menus m WHERE m.role_name = p.role_name) AS menu_count,
           array_to_string(list_slice(list(code ORDER BY code), 1, 4), ',') AS first_codes,
           CAST(greatest(count(*) - 4, 0) AS BIGINT) AS remainder FROM p1_role_permissions p GROUP BY role_name""")
def role_cards(spark, sf):
    rows = access.role_cards(p1.role_permissions(spark, sf), p1.role_menus(spark, sf))
    return rows.withColumn("first_codes", F.array_join("first_codes", ","))


@query("d15_visible_menus", "p1_user_roles", "p1_role_permissions", "p1_role_menus", sql="""
    SELECT DISTINCT user_id, menu_code FROM p1_user_roles JOIN p1_role_menus USING (role_name) WHERE menu_code IN ('menu_5', 'menu_6')
    UNION SELECT user_id, unnest(['menu_5', 'menu_6', 'audit']) FROM p1_user_roles JOIN p1_role_permissions USING (role_name) WHERE code = 'admin:*'""")
def visible_menus(spark, sf):
    return access.visible_menus(_access(spark, sf), ("menu_5", "menu_6", "audit"))

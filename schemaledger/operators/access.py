"""Users, roles, permissions and menus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import model


def user_permissions(user_roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """(user_id, code) through the role links.

    Both link tables are made distinct first, so repeated links do not multiply in the join.
    """
    return user_roles.distinct().join(role_permissions.distinct(), "role_name").select("user_id", "code")


def effective_access(user_roles: DataFrame, role_permissions: DataFrame, role_menus: DataFrame) -> DataFrame:
    """Per user: role names, distinct sorted permission codes, and menu codes with repeats kept.

    Codes and menus are gathered per role first (their number is bounded by the permission and menu catalogues), so
    the join carries one row per user and role instead of one per code.
    """
    codes = role_permissions.distinct().groupBy("role_name").agg(F.collect_set("code").alias("_codes"))
    menus = role_menus.distinct().groupBy("role_name").agg(F.sort_array(F.collect_list("menu_code")).alias("_menus"))
    per_role = codes.join(menus, "role_name", "full_outer")
    linked = user_roles.distinct().join(per_role, "role_name", "left")
    by_role = F.array_sort(F.collect_list(F.struct("role_name", "_menus")))
    return linked.groupBy("user_id").agg(
        F.array_sort(F.collect_set("role_name")).alias("roles"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("_codes", F.array().cast("array<string>")))))).alias("permissions"),
        F.flatten(F.transform(by_role, lambda r: F.coalesce(r["_menus"], F.array().cast("array<string>")))).alias("menus"),
    )


def allows(codes: Column, needed: str) -> Column:
    """Permission test on an array of codes."""
    return F.array_contains(codes, model.ADMIN_CODE) | F.array_contains(codes, needed)


def users_allowed(user_roles: DataFrame, role_permissions: DataFrame, needed: str) -> DataFrame:
    """Users who may do it. Only the roles that grant it take part in the join."""
    granting = role_permissions.where(F.col("code").isin(model.ADMIN_CODE, needed)).select("role_name").distinct()
    return user_roles.join(granting, "role_name", "left_semi").select("user_id").distinct()


def permission_check(user_roles: DataFrame, role_permissions: DataFrame, needed: str) -> DataFrame:
    """One row per user with `allowed`."""
    granting = role_permissions.where(F.col("code").isin(model.ADMIN_CODE, needed)).select("role_name").distinct()
    flagged = user_roles.join(granting.withColumn("_grants", F.lit(True)), "role_name", "left")
    return flagged.groupBy("user_id").agg(F.bool_or(F.coalesce("_grants", F.lit(False))).alias("allowed"))


def attributes_by_ids(requests: DataFrame, attributes: DataFrame, ids: str = "ids", key: str = "id") -> DataFrame:
    """Attributes whose id is listed in any request; unknown ids are ignored."""
    asked = requests.select(F.explode(ids).alias(key)).distinct()
    return attributes.join(asked, key, "left_semi")


def role_cards(role_permissions: DataFrame, role_menus: DataFrame, shown: int = 4) -> DataFrame:
    """Per role: permission and menu counts, the first codes, and how many are not shown."""
    codes = role_permissions.distinct().groupBy("role_name").agg(F.array_sort(F.collect_list("code")).alias("_codes"))
    menus = role_menus.distinct().groupBy("role_name").agg(F.count("*").alias("menu_count"))
    both = codes.join(menus, "role_name", "full_outer")
    listed = F.coalesce("_codes", F.array().cast("array<string>"))
    return both.select(
        "role_name", F.size(listed).cast("bigint").alias("permission_count"),
        F.coalesce("menu_count", F.lit(0).cast("bigint")).alias("menu_count"),
        F.slice(listed, 1, shown).alias("first_codes"),
        F.greatest(F.size(listed) - shown, F.lit(0)).cast("bigint").alias("remainder"),
    )


def visible_menus(access: DataFrame, navigation: tuple[str, ...] = model.NAVIGATION) -> DataFrame:
    """(user_id, menu_code) of the navigation entries a user sees: those granted, or all for an administrator.

    The navigation of the console is a fixed short list, so it is a literal and no join is needed.
    """
    admin = F.array_contains("permissions", model.ADMIN_CODE)
    entries = F.array(*[F.lit(n) for n in navigation])
    seen = F.filter(entries, lambda n: admin | F.array_contains("menus", n))
    return access.select("user_id", F.explode(seen).alias("menu_code"))

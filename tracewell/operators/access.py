"""Visibility: owners, users and groups that are allowed, the group Everyone, administrators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(objects: DataFrame, user_grants: DataFrame, group_grants: DataFrame, memberships: DataFrame, user: int, everyone: int, *, admin: bool = False, only_granted: bool = False) -> DataFrame:
    """The objects (id, owner, ...) that a user sees: their own, those granted to them, to a group of
    theirs or to everyone.  Administrators see all unless `only_granted` asks for the plain view.

    Grants meet in a semi join, so an object granted in several ways appears once.
    """
    if admin and not only_granted:
        return objects
    own = objects.where(F.col("owner") == user).select("id")
    direct = user_grants.where(F.col("user_id") == user).select(F.col("object_id").alias("id"))
    mine = memberships.where(F.col("user_id") == user).select("group_id")
    by_group = group_grants.join(mine, "group_id", "left_semi").select(F.col("object_id").alias("id"))
    public = group_grants.where(F.col("group_id") == everyone).select(F.col("object_id").alias("id"))
    return objects.join(own.unionByName(direct).unionByName(by_group).unionByName(public), "id", "left_semi")


def allowed_by_all(grants: DataFrame, who: str, n_objects: int) -> DataFrame:
    """Those (column `who`) whom every one of n objects allows: relational division."""
    return grants.groupBy(who).agg(F.count_distinct("object_id").alias("n")).where(F.col("n") == n_objects).select(who)


def not_covered(wanted: DataFrame, allowed: DataFrame, who: str) -> DataFrame:
    """Those who would gain access although not all limiting objects allow them."""
    return wanted.select(who).distinct().join(allowed, who, "left_anti")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side's name; empty if access is identical."""
    return a.exceptAll(b).distinct().withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).distinct().withColumn("side", F.lit("right")))


def intersect(choices: DataFrame, allowed: DataFrame, who: str, everyone: bool) -> DataFrame:
    """Choices that an object's permissions include; all of them where everyone is included."""
    return choices if everyone else choices.join(allowed, who, "left_semi")


def may(method: Column, admin: Column, visible: Column, owner: Column) -> Column:
    """Whether a request on a run is allowed: administrators may all, others read what they see and stop their own."""
    return admin | (visible & F.when(method == "PATCH", owner).otherwise(method.isin("GET", "HEAD", "OPTIONS")))


def administered(objects: DataFrame, *, asked: bool, admin: bool) -> DataFrame:
    """All objects, for administrators who ask for that; others who ask get an error."""
    if asked and not admin:
        raise PermissionError("only administrators see everything")
    return objects


def granted(permissions: Column) -> Column:
    """Users and groups of the JSON text [[users], [groups]]."""
    lists = F.from_json(permissions, "array<array<string>>")
    return F.struct(F.get(lists, F.lit(0)).alias("users"), F.get(lists, F.lit(1)).alias("groups"))

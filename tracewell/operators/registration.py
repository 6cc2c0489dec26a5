"""New rows of a catalog: registered files, bulk uploads, guarded updates, free names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.retention import running_total_within


def registered(files: DataFrame, content: str = "content", path: str = "path", roots: DataFrame | None = None) -> DataFrame:
    """files with md5, size and, below a known root (name, root), where they lie: root_name and relative path.

    A file below several roots counts for the longest; one below none has nulls there.  Without content
    (null: the file is missing) md5 is empty.
    """
    out = files.withColumns({"md5": F.coalesce(F.md5(content), F.lit("")), "size": F.length(content).cast("long")})
    if roots is None:
        return out
    folders = F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda i: F.array_join(F.slice(F.split(path, "/"), F.lit(1), i), "/"))
    above = files.select(path, F.explode(folders).alias("root")).distinct().join(roots.withColumnRenamed("name", "root_name"), "root")
    best = above.groupBy(path).agg(F.max_by(F.struct("root_name", "root"), F.length("root")).alias("best"))
    met = out.join(best, path, "left")
    return met.select(*out.columns, F.col("best.root_name").alias("root_name"), F.expr(f"substring({path}, length(best.root) + 2)").alias("relative"))


def intact(files: DataFrame, content: str = "content", md5: str = "md5") -> DataFrame:
    """files with whether their content still has the digest they were registered with."""
    return files.withColumn("intact", F.coalesce(F.md5(content), F.lit("")) == F.col(md5))


def uploaded(members: DataFrame, existing: DataFrame, name: str = "name", md5: str = "md5", ordinal: str = "ordinal", described: str = "") -> DataFrame:
    """Bulk upload: one row for each member with its name, description and error (null if it becomes a dataset).

    `/` in names becomes `_`, names without one are called after their place; an empty file, a name and
    digest that the catalog has, or that an earlier member has, are errors.
    """
    clean = F.translate(F.coalesce(name, F.lit("")), "/", "_")
    rows = members.withColumn("new_name", F.when(clean == "", F.concat(F.lit("dataset_"), F.col(ordinal).cast("string"))).otherwise(clean))
    had = existing.select(F.col(name).alias("new_name"), F.col(md5).alias(md5)).distinct().withColumn("__had", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("new_name", md5).orderBy(ordinal))
    met = rows.join(had, ["new_name", md5], "left").withColumn("__nth", nth)
    error = F.when(F.col("size") == 0, "empty file").when(F.coalesce("__had", F.lit(False)), "already in the catalog").when(F.col("__nth") > 1, "twice in the upload")
    text = F.concat(F.lit(described or "uploaded as "), F.col(name))
    return met.select(*members.columns, "new_name", text.alias("description"), error.alias("error"))


def updated(rows: DataFrame, guard: Column, **changes: Column) -> DataFrame:
    """rows with some columns changed where the guard holds: a conditional update, as UPDATE ... WHERE."""
    return rows.withColumns({c: F.when(F.coalesce(guard, F.lit(False)), v).otherwise(F.col(c)) for c, v in changes.items()})


def listed_updates(rows: DataFrame, ids: DataFrame, key: str, **changes: Column) -> DataFrame:
    """rows with some columns changed where the key is in a table: UPDATE ... WHERE key IN (...)."""
    marked = rows.join(ids.select(key).distinct().withColumn("__in", F.lit(True)), key, "left")
    return updated(marked, F.col("__in"), **changes).drop("__in").select(*rows.columns)


#: Fixed states of a run, and those that may follow each: any active one may fail or be stopped.
MOVES = {"N": "LFX", "L": "RFX", "R": "SFX", "S": "CFX"}


def is_active(state: Column) -> Column:
    """Whether a run's state may still change."""
    return state.isin(*MOVES)


def may_follow(before: Column, after: Column) -> Column:
    """Whether a run may go from one state to another."""
    return F.coalesce(F.contains(F.try_element_at(F.create_map(*[F.lit(x) for pair in MOVES.items() for x in pair]), before), after), F.lit(False))


def moved(runs: DataFrame, wishes: DataFrame) -> DataFrame:
    """Runs (id, state) after wished states (id, new_state), each of which counts only if it is a move that the
    present state allows; `refused` tells where it wasn't."""
    met = runs.join(wishes, "id", "left")
    allowed = may_follow(F.col("state"), F.col("new_state"))
    asked = F.col("new_state").isNotNull()
    return met.withColumns({"refused": asked & ~allowed, "state": F.when(asked & allowed, F.col("new_state")).otherwise(F.col("state"))}).drop("new_state")


def free_names(wanted: DataFrame, taken: DataFrame, name: str = "name", order: str = "id", sep: str = "_") -> DataFrame:
    """wanted with `free`: the name itself for the first who wants it if nobody has it, else with the first free
    number behind it, the others' in their order.

    A number isn't free if somebody has or wants that very name, so all names that are given are distinct.  Null names stay
    null.  Ranks and numbers are counted by ranges of all rows: any number of rows may want one name.
    """
    own, step = F.col(name), F.lit(1).cast("long")
    rows = wanted.where(own.isNotNull())
    ranked = running_total_within(rows.withColumn("__one", step), name, [F.col(order)], "__one", "__rank").drop("__one")
    had = taken.where(own.isNotNull()).select(own.alias("__had")).distinct()
    asked = ranked.join(had, own == F.col("__had"), "left").withColumn("__rank", F.col("__rank") + F.when(F.col("__had").isNotNull(), 1).otherwise(0)).drop("__had")
    # Numbers that are gone, and how many free ones lie below each.
    cut = rf"^(.*){re.escape(sep)}([1-9][0-9]{{0,17}})$"
    gone = had.select(F.col("__had").alias("full")).union(rows.select(own)).distinct()
    gone = gone.where(F.col("full").rlike(cut)).select(F.regexp_extract("full", cut, 1).alias("base"), F.regexp_extract("full", cut, 2).cast("long").alias("number"))
    gone = gone.join(rows.select(own.alias("base")).distinct(), "base", "left_semi").withColumn("one", step)
    gone = running_total_within(gone, "base", [F.col("number")], "one", "below").select("base", (F.col("number") - F.col("below") - 1).alias("at"), F.lit(None).cast("long").alias("rank"), step.alias("gone"))
    # The m-th free number is m and the gone ones that fewer than m free numbers lie below.
    places = asked.where("__rank > 0").select(own.alias("base"), F.col("__rank").alias("at"), F.col("__rank").alias("rank"), F.lit(0).cast("long").alias("gone"))
    counted = running_total_within(gone.union(places), "base", [F.col("at"), F.col("rank").desc_nulls_last()], "gone", "before").where("rank is not null")
    numbers = counted.select(F.col("base").alias("__base"), F.col("rank").alias("__at"), (F.col("rank") + F.col("before")).alias("__number"))
    met = asked.join(numbers, (own == F.col("__base")) & (F.col("__rank") == F.col("__at")), "left")
    given = met.withColumn("free", F.when(F.col("__rank") == 0, own).otherwise(F.concat(own, F.lit(sep), F.col("__number").cast("string"))))
    return given.select(*wanted.columns, "free").unionByName(wanted.where(own.isNull()).withColumn("free", F.lit(None).cast("string")))


def first_free_entry(entries: DataFrame, archive: str, name: str, pattern: str = "pipelines/pipeline{}.json") -> DataFrame:
    """archive and the first numbered entry name, from 1 on, that it doesn't have yet."""
    before, after = pattern.split("{}")
    number = F.regexp_extract(name, "^" + re.escape(before) + "([1-9][0-9]*)" + re.escape(after) + "$", 1).try_cast("int")
    used = entries.groupBy(archive).agg(F.collect_set(number).alias("used"))
    n = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("used") + 1), "used"))
    return used.select(archive, F.concat(F.lit(before), n.cast("string"), F.lit(after)).alias("entry"))

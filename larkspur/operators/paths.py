"""Aliases for file and folder names, with counters that resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extension, stem
from ..sources.shared import durable
from .detectors import detect


def placeholder(name: Column) -> Column:
    """A name with its numbers replaced by their kind: an existing yyyyMMdd from
    1900 to 2199 by DATE, any other run of six digits or more by ID."""
    return F.concat(F.regexp_replace(F.regexp_replace(stem(name), _DAY, "DATE"), r"[0-9]{6,}", "ID"), extension(name))


_DAY = r"(?<![0-9])((?:19|20|21)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01]))(?![0-9])"


def numbers_in(name: Column) -> Column:
    """What placeholder() replaces in a name, as structs of value and category."""
    as_ = lambda kind: lambda x: F.struct(x.alias("value"), F.lit(kind).alias("category"))
    days = F.regexp_extract_all(stem(name), F.lit(_DAY), 1)
    rest = F.regexp_extract_all(F.regexp_replace(stem(name), _DAY, "DATE"), F.lit("([0-9]{6,})"), 1)
    return F.concat(F.transform(days, as_("DATE")), F.transform(rest, as_("ID")))


def detected(names: DataFrame, col: str, detector, **calls) -> DataFrame:
    """(name, base, found) of the distinct names in `col`: what a detector finds
    replaced by its type in capitals, then numbers as in placeholder(). A name
    for which the detector fails gets the base `anonymized_<name>`."""
    each = names.select(F.col(col).alias("name")).distinct()
    got = detect(each.select(F.col("name").alias("unit"), F.lit("").alias("col"), stem(F.col("name")).alias("text")), detector, **calls)
    hit = F.when(F.col("text").isNotNull(), F.struct(F.col("text").alias("value"), F.upper(F.coalesce("type", F.lit("id"))).alias("category")))
    per = got.groupBy("unit").agg(F.collect_set(hit).alias("hits"), F.max(F.col("error").isNotNull()).alias("failed"))
    rows = each.join(per, each["name"] == per["unit"], "left").drop("unit")
    # The longest first, so that none is cut by another.
    ordered = F.transform(F.array_sort(F.transform("hits", lambda x: F.struct((-F.length(x["value"])).alias("n"), x["value"].alias("v"), x["category"].alias("c")))), lambda x: F.struct(x["v"].alias("value"), x["c"].alias("category")))
    hits = F.coalesce(ordered, F.array().cast("array<struct<value:string,category:string>>"))
    told = F.aggregate(hits, stem(F.col("name")), lambda a, x: F.replace(a, x["value"], x["category"]))
    base = F.when(F.coalesce("failed", F.lit(False)), F.concat(F.lit("anonymized_"), "name")).otherwise(placeholder(F.concat(told, extension(F.col("name")))))
    return rows.select("name", base.alias("base"), F.concat(hits, numbers_in(F.concat(told, extension(F.col("name"))))).alias("found"))


def numbered(names: DataFrame, keys: list[str], order: str, known: DataFrame | None, digits: int, base: str) -> DataFrame:
    """A `counter` per `keys`, from the largest known one on, and an `alias`.
    Names are numbered within ranges of (keys, order), whose counts say what
    comes before, so no key gathers in one task."""
    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(names.repartitionByRange(n, *keys, order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")  # a row a key and range
    nth = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(order))
    same = [ranged[k].eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    before = counts.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), ahead.alias("_ahead"))
    names = ranged.join(before, [ranged["_part"] == F.col("_p"), *same]).withColumn("_nth", nth + F.col("_ahead")).drop("_p", "_ahead", "_part", *[f"_{i}" for i in range(len(keys))])
    if known is None:
        names = names.withColumn("_from", F.lit(0))
    else:
        so_far = known.groupBy(*keys).agg(F.max("counter").alias("_from"))
        names = names.join(so_far, keys, "left").fillna(0, ["_from"])
    names = names.withColumn("counter", (F.col("_nth") + F.col("_from")).cast("int")).drop("_from", "_nth")
    number = F.format_string(f"_%0{digits}d", F.col("counter"))  # grows beyond its digits rather than being cut
    return names.withColumn("alias", F.concat(stem(F.col(base)), number, extension(F.col(base))))


def _based(names: DataFrame, col: str, bases: DataFrame | None) -> DataFrame:
    """`names` with the base of each name: of detected(), or by its numbers."""
    if bases is None:
        return names.withColumn("base", placeholder(F.col(col)))
    return names.join(bases.select(F.col("name").alias(col), "base"), col)


def alias_folders(paths: DataFrame, known: DataFrame | None = None, bases: DataFrame | None = None) -> DataFrame:
    """(folder, base, counter, alias) for every folder part of `path`: counters
    for names that hold an id, others keep their placeholder. Known folders
    (same columns) keep their aliases. `bases`: a table of detected()."""
    parts = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    folders = paths.select(F.explode(parts).alias("folder")).where("folder <> ''").distinct()
    if known is not None:
        folders = folders.join(known.select("folder"), "folder", "left_anti")
    based = _based(folders, "folder", bases)
    with_id = numbered(based.where("base like '%ID%'"), ["base"], "folder", known, 3, "base")
    rest = based.where("base not like '%ID%'").withColumn("counter", F.lit(0)).withColumn("alias", F.col("base"))
    new = with_id.unionByName(rest)
    return new if known is None else known.select(new.columns).unionByName(new)


def alias_files(files: DataFrame, known: DataFrame | None = None, bases: DataFrame | None = None) -> DataFrame:
    """(folder, name, base, counter, alias) for files (folder, name); a counter
    per folder and placeholder, for files in a folder."""
    files = files.select("folder", "name").distinct()
    if known is not None:
        files = files.join(known.select("folder", "name"), ["folder", "name"], "left_anti")
    based = _based(files, "name", bases).select("folder", "name", "base")
    new = numbered(based.where("folder <> ''"), ["folder", "base"], "name", known, 4, "base")
    new = new.unionByName(based.where("folder = ''").withColumn("counter", F.lit(0)).withColumn("alias", F.col("base"))).select("folder", "name", "base", "counter", "alias")
    return new if known is None else known.select(new.columns).unionByName(new)


def resumed_counter(alias: Column, digits: int) -> Column:
    """The counter in an alias made before, or 0."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(stem(alias), rf"^.+_([0-9]{{{digits},}})$", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))


def mapping_table(aliases: DataFrame, original: str, found: str, *more: str) -> DataFrame:
    """What mapping files hold: changed names, with the values found (structs of
    value and category) joined by "; ", and the columns `more`."""
    join = lambda k: F.array_join(F.transform(F.col(found), lambda x: x[k]), "; ")
    changed = aliases.where(F.col(original) != F.col("alias"))
    return changed.select(F.col(original).alias("original"), F.col("alias").alias("anonymized"), join("value").alias("phi_values"), join("category").alias("phi_categories"), *more)

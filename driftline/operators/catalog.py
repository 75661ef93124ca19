"""Table selections, column catalogs and schema reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.cells import normalize_type
from driftline.operators.graph import dependency_order
from driftline.sources.scratch import append, new_path

#: The system's own keyspaces, without case.
SYSTEM_KEYSPACES = ["system", "system_auth", "system_distributed", "system_schema", "system_traces", "system_views", "system_virtual_schema", "system_cosmos", "system_cosmos_internal"]


def user_tables(tables: DataFrame) -> DataFrame:
    """(keyspace, tbl) outside the system's keyspaces, in order."""
    return tables.where(~F.lower("keyspace").isin(SYSTEM_KEYSPACES)).orderBy("keyspace", "tbl")


def schema_rows(df: DataFrame, tbl: str, partition: list[str] = (), clustering: dict[str, str] | None = None, static: list[str] = ()) -> DataFrame:
    """A DataFrame's columns as catalog rows: tbl, name, type, kind, clustering
    order (asc, desc or none) and position.  Keys are numbered within their
    kind, other columns have position -1."""
    clustering = clustering or {}
    keys = {**{c: ("partition_key", i) for i, c in enumerate(partition)}, **{c: ("clustering", i) for i, c in enumerate(clustering)}}
    rows = [(tbl, f.name, f.dataType.simpleString(), *keys.get(f.name, ("static" if f.name in static else "regular", -1)), clustering.get(f.name, "none")) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "tbl string, name string, type string, kind string, position int, clustering_order string")


def clustered(rows: DataFrame, partition: list[str], clustering: dict[str, str]) -> DataFrame:
    """Rows dealt by partition key and, within a task, ordered by it and by the
    clustering keys in their declared orders (asc or desc)."""
    order = [F.col(c).desc() if way == "desc" else F.col(c).asc() for c, way in clustering.items()]
    return rows.repartition(*partition).sortWithinPartitions(*partition, *order)


def type_fields(types: DataFrame) -> DataFrame:
    """One row per field of each user type, in order."""
    z = F.posexplode(F.arrays_zip("field_names", "field_types")).alias("position", "f")
    return types.select("type_name", z).select("type_name", "position", F.col("f.field_names").alias("field"), F.col("f.field_types").alias("type"))


def project_by_name(df: DataFrame, order: list[str]) -> DataFrame:
    """Columns in the target's order, matched without case."""
    own = {c.lower(): c for c in df.columns}
    return df.select(*[F.col(own[c.lower()]).alias(c) for c in order])


def key_columns(columns: DataFrame) -> DataFrame:
    """(tbl, keys, orders): partition keys, then clustering keys, each by
    position, and the clustering order of each (none for partition keys)."""
    rank = F.when(F.col("kind") == "partition_key", 0).otherwise(1)
    keys = columns.where(F.col("kind").isin("partition_key", "clustering"))
    each = F.array_sort(F.collect_list(F.struct(rank, "position", "name", "clustering_order")))
    return keys.groupBy("tbl").agg(each.alias("k")).select("tbl", F.col("k.name").alias("keys"), F.col("k.clustering_order").alias("orders"))


def split_by_kind(cells: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key cells, data cells, unknown) of long rows with a ``column``."""
    kinds = columns.select(F.col("name").alias("column"), "kind")
    both = cells.join(kinds, "column", "left")
    is_key = F.col("kind").isin("partition_key", "clustering")
    return both.where(is_key), both.where(F.col("kind").isNotNull() & ~is_key), both.where(F.col("kind").isNull()).drop("kind")


def parse_selection(lists: DataFrame, column: str = "selection") -> DataFrame:
    """One row per entry of selection texts (split at commas, semicolons and
    line ends): keyspace, tbl (``*`` for all) and whether the entry is valid.
    Either part may be quoted, with a doubled quote for one."""
    entries = lists.select("*", F.posexplode(F.split(F.col(column), r"[,;\n\r]")).alias("pos", "raw"))
    entries = entries.withColumn("entry", F.trim("raw")).where("entry <> ''")
    quoted, plain = r'"((?!")[^"]*+(?:""[^"]*+)*+|(?:"")++[^"]*+(?:""[^"]*+)*+)"', r"([A-Za-z][A-Za-z0-9_]*)"
    pattern = rf"^(?:{quoted}|{plain})\.(?:{quoted}|{plain}|(\*))$"
    part = lambda i: F.regexp_extract("entry", pattern, i)
    bare = lambda c: F.replace(c, F.lit('""'), F.lit('"'))
    keyspace = F.when(part(1) != "", bare(part(1))).otherwise(part(2))
    tbl = F.when(part(3) != "", bare(part(3))).when(part(4) != "", part(4)).otherwise(part(5))
    return entries.drop("raw").select("*", F.nullif(keyspace, F.lit("")).alias("keyspace"), F.nullif(tbl, F.lit("")).alias("tbl"), F.col("entry").rlike(pattern).alias("valid"))


def expand_wildcards(entries: DataFrame, tables: DataFrame) -> DataFrame:
    """Explicit entries and, for ``*``, every table of the keyspace; the first
    of equal (keyspace, tbl) stays."""
    stars = entries.where("tbl = '*'").select("keyspace", "pos").join(tables.select("keyspace", "tbl"), "keyspace")
    return dedupe_units(entries.where("tbl <> '*'").select("keyspace", "pos", "tbl").unionByName(stars))


def dedupe_units(units: DataFrame) -> DataFrame:
    """First occurrence (by pos) of each (keyspace, tbl)."""
    return units.groupBy("keyspace", "tbl").agg(F.min("pos").alias("pos"))


def target_clashes(units: DataFrame) -> DataFrame:
    """Targets, without case, that more than one source maps to."""
    by = units.groupBy(F.lower("target").alias("target")).agg(F.count_distinct("source").alias("sources"))
    return by.where("sources > 1")


def missing_columns(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source columns that are no keys and that the target lacks.  Both sides
    are sorted: a catalog's size is underestimated (it is often exploded from
    fewer rows), and as a broadcast every task would hold it whole."""
    have = target.select("tbl", F.lower("name").alias("lname")).hint("merge")
    return source.where(F.col("kind").isin("regular", "static")).withColumn("lname", F.lower("name")).join(have, ["tbl", "lname"], "left_anti").drop("lname")


def schema_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Keys of both schemas side by side by kind and position."""
    key = F.col("kind").isin("partition_key", "clustering")
    side = lambda df, x: df.where(key).select("tbl", "kind", "position", F.col("name").alias(f"{x}_name"), normalize_type(F.col("type")).alias(f"{x}_type"), F.lower("clustering_order").alias(f"{x}_order"))
    s, t = side(source, "s"), side(target, "t")
    return s.join(t, ["tbl", "kind", "position"], "full")


def schema_compat(source: DataFrame, target: DataFrame) -> DataFrame:
    """(tbl, reasons): why the keys of two schemas do not match; one reason for
    the partition key, one for the clustering key (its first difference)."""
    d = schema_diff(source, target)
    why = (
        F.when(F.col("s_name").isNull() | F.col("t_name").isNull(), "count")
        .when(F.lower("s_name") != F.lower("t_name"), "name")
        .when(F.col("s_type") != F.col("t_type"), "type")
        .when(F.col("s_order") != F.col("t_order"), "order")
    )
    bad = d.withColumn("why", why).where("why is not null")
    first = bad.groupBy("tbl", "kind").agg(F.min_by("why", "position").alias("why"))
    found = first.groupBy("tbl").agg(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "why"))).alias("reasons"))
    tables = source.select("tbl").distinct()
    return tables.join(found, "tbl", "left").select("tbl", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def schema_action(compat: DataFrame, targets: DataFrame) -> DataFrame:
    """What to do per table; ``targets`` has tbl and has_data of existing ones."""
    both = compat.join(targets, "tbl", "left")
    bad = F.size("reasons") > 0
    action = F.when(F.col("has_data").isNull(), "create").when(bad & F.col("has_data"), "refuse").when(bad, "recreate").otherwise("add_missing")
    return both.select("tbl", action.alias("action"))


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns that only ``new`` has are null in old rows."""
    return old.unionByName(new, allowMissingColumns=True)


def reachable(edges: DataFrame) -> DataFrame:
    """(src, dst) pairs of nodes and all that they reach, by doubling paths.

    A pair is kept once, at its shortest way.  A round of ``reach`` takes only
    ways of just that length and goes on with all known ones, so each pair is
    derived once per node in the middle of its shortest ways; if no way is that
    long, none is longer.  Joins are sorted: files of pairs are so dense that
    they would be broadcast at millions of rows.
    """
    path, kinds = new_path(edges.sparkSession, "paths"), edges.schema
    append(edges.select("src", "dst", F.lit(1).cast("long").alias("hops")).distinct(), path)
    reach = 1
    while True:
        now = edges.sparkSession.read.schema(f"src {kinds['src'].dataType.simpleString()}, dst {kinds['dst'].dataType.simpleString()}, hops long").parquet(path)
        far = now.where(F.col("hops") == reach).select("src", F.col("dst").alias("via"))
        if far.isEmpty():
            return now.select("src", "dst")
        on = now.select(F.col("src").alias("via"), "dst", (F.col("hops") + reach).alias("hops"))
        found = far.join(on.hint("merge"), "via").groupBy("src", "dst").agg(F.min("hops").alias("hops"))
        known = now.select(F.col("src").alias("a"), F.col("dst").alias("b")).hint("merge")
        append(found.join(known, F.col("src").eqNullSafe(F.col("a")) & F.col("dst").eqNullSafe(F.col("b")), "left_anti"), path)
        reach *= 2


def dependency_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): a node's level is one above the highest it depends on;
    nodes on cycles, or that need such nodes, have a null level."""
    return dependency_order(edges, nodes).select("node", "level")

"""Applying planned mutations to a target, deletions included.

A mutation is taken apart into atoms: a cell (of a column, or of one element,
key or field of it), a row's marker, or a deletion of one of three scopes: a
whole row, a whole column, or (a deleted cell) one element.  The state is the
newest atom per place, less what a deletion of a wider scope shadows, so it
does not depend on the order of arrival or on repeats.  At equal times a
deletion wins, then the larger value, then the later expiry (none is latest).

Overwriting a collection or a type of fields with a value clears it just before
(at ``wt`` - 1) and adds the value's parts; a null leaves the clearing alone.
The parts of a list are placed by time and position.  Static cells belong to
the partition: their clustering keys are null, and no row's deletion shadows
them.

Scale: atoms are exploded in place and combined before the shuffle, so a hot
key costs one row per task and place.  Deletions of wider scope meet their
cells in a window over the row's key, after that: what a task holds together
are the places of one row.  ``compact`` is closed: its result is atoms again,
so a log can be compacted over and over; with a horizon it also collects
deletions and what has expired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.cells import is_expired
from driftline.operators.decode import hold

#: Scopes of atoms.
CELL, MARKER, CLEAR, ROW = "cell", "marker", "clear", "row"
PLACE, FACTS = ["scope", "column", "path"], ["value", "wt", "expiry", "del"]


def _in(names: list[str], c: str) -> str:
    return f"{c} in ({', '.join(repr(n) for n in names)})" if names else "false"


def atoms(mutations: DataFrame, keys: list[str], classes: dict[str, str], clustering: list[str] = (), statics: list[str] = ()) -> DataFrame:
    """Atoms of the output of ``mutations.plan``: keys, scope, column, path,
    value, wt, expiry, del.  ``classes`` as for the plan."""
    of = lambda *kinds: [c for c, k in classes.items() if k in kinds]
    lists, sets, maps = of("list"), of("set"), of("map", "udt")

    def atom(scope: str, column: str, path: str, value: str, wt: str, expiry: str, gone: str, static: str) -> str:
        return (
            f"named_struct('scope', '{scope}', 'column', cast({column} as string), 'path', cast({path} as string), 'value', cast({value} as string), 'wt', cast({wt} as bigint), "
            f"'expiry', cast({expiry} as bigint), 'del', {gone}, 'static', {static})"
        )

    def parts(column: str, text: str, static: str) -> str:
        """Atoms of the elements, keys or fields in ``text``."""
        element = atom(CELL, column, "x", "null", "wt", "expiry", "false", static)
        place = "concat(lpad(cast(wt as string), 20, '0'), '.', lpad(cast(i as string), 9, '0'))"
        member = atom(CELL, column, "e.key", "e.value", "wt", "expiry", "e.value is null", static)
        return f"""case when {_in(sets, column)} then transform(from_json({text}, 'array<string>'), x -> {element})
          when {_in(lists, column)} then transform(from_json({text}, 'array<string>'), (x, i) -> {atom(CELL, column, place, 'x', 'wt', 'expiry', 'false', static)})
          else transform(map_entries(from_json({text}, 'map<string,string>')), e -> {member}) end"""

    clear = lambda column, wt, static: atom(CLEAR, column, "null", "null", wt, "null", "true", static)

    def write(column: str, text: str, static: str) -> str:
        """Atoms of setting a column to ``text``."""
        whole = atom(CELL, column, "''", text, "wt", f"if({text} is null, null, expiry)", f"{text} is null", static)
        return f"if({_in([*lists, *sets, *maps], column)}, concat(array({clear(column, 'wt - 1', static)}), coalesce({parts(column, text, static)}, array())), array({whole}))"

    own = "is_static"
    member_static = _in(list(statics), "m.key")
    members = f"filter(map_entries(from_json(value, 'map<string,string>')), m -> {_in(list(classes), 'm.key')})"
    removed = atom(CELL, "column", "x", "null", "wt", "null", "true", own)
    each = f"""case
      when op in ('full_insert', 'baseline') then concat(array({atom(MARKER, 'null', 'null', 'null', 'wt', 'expiry', 'false', 'false')}), flatten(transform({members}, m -> {write('m.key', 'm.value', member_static)})))
      when op in ('set_group', 'list_set') then {write('column', 'value', own)}
      when op in ('add', 'list_append') then {parts('column', 'value', own)}
      when op = 'field' then array({atom(CELL, 'column', 'path', 'value', 'wt', 'expiry', 'value is null', own)})
      when op = 'remove' then transform(from_json(value, 'array<string>'), x -> {removed})
      when op = 'list_clear' then array({clear('column', 'wt', own)})
      when op = 'row_delete' then array({atom(ROW, 'null', 'null', 'null', 'wt', 'null', 'true', 'false')}) end"""
    out = mutations.select(*keys, F.explode(F.expr(each)).alias("a"))
    named = [F.when(~F.col("a.static"), F.col(k)).alias(k) if k in clustering else F.col(k) for k in keys]
    return out.select(*named, *[F.col(f"a.{c}").alias(c) for c in [*PLACE, *FACTS]])


def newest_atoms(log: DataFrame, keys: list[str]) -> DataFrame:
    """One atom per place: the winner.  Its result can be merged again."""
    order = F.struct("wt", "del", "value", F.col("expiry").isNull(), "expiry")
    won = log.groupBy(*keys, *PLACE).agg(F.max_by(F.struct(*FACTS), order).alias("w"))
    return won.select(*keys, *PLACE, *[F.col(f"w.{c}").alias(c) for c in FACTS])


def unshadowed(won: DataFrame, keys: list[str]) -> DataFrame:
    """Winning atoms that no deletion of wider scope shadows."""
    row, column = Window.partitionBy(*keys), Window.partitionBy(*keys, "column")
    at = lambda scope, w: F.max(F.when(F.col("scope") == scope, F.col("wt"))).over(w)
    both = won.withColumn("_row", at(ROW, row)).withColumn("_column", at(CLEAR, column))
    newer = lambda than: F.col(than).isNull() | (F.col("wt") > F.col(than))
    part = F.col("scope").isin(CELL, MARKER)
    kept = (F.col("scope") == ROW) | (newer("_row") & (~part | newer("_column")))
    return both.where(kept).drop("_row", "_column")


def state(log: DataFrame, keys: list[str]) -> DataFrame:
    """Cells and markers (a null ``column``) of the target: keys, column, path,
    value, wt, expiry, del (a deleted element that nothing wider covers)."""
    return unshadowed(newest_atoms(log, keys), keys).where(F.col("scope").isin(CELL, MARKER)).drop("scope")


def live(cells: DataFrame, now: int) -> DataFrame:
    """What is neither deleted nor expired at ``now``."""
    return cells.where(~F.col("del") & ~is_expired(F.col("expiry"), now)).drop("del")


def late(log: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """(on time, late): atoms at or before ``horizon`` come after deletions of
    their time may have been collected, and must not be merged."""
    return log.where(F.col("wt") > horizon), log.where(F.col("wt") <= horizon)


def compact(log: DataFrame, keys: list[str], horizon: int | None = None, now: int | None = None) -> DataFrame:
    """A log of atoms as few as its state needs.  Without a horizon nothing is
    forgotten.  With one (microseconds), deletions up to it are collected, and
    so are cells that expired at ``now`` and whose expiry lies before it; what
    they shadowed goes in the same step, so nothing is revived as long as
    ``late`` keeps older atoms out."""
    won = unshadowed(newest_atoms(log, keys), keys)
    if horizon is None:
        return won
    old = F.col("wt") <= horizon
    dead = F.lit(False) if now is None else is_expired(F.col("expiry"), now) & (F.col("expiry") * 1_000_000 <= horizon)
    return won.where(~(old & (F.col("del") | dead)))


def rows(cells: DataFrame, keys: list[str], classes: dict[str, str], clustering: list[str] = (), statics: list[str] = ()) -> DataFrame:
    """Live cells as one row per key: a text per column, JSON for those of
    parts (sets and lists as arrays, maps and fields as objects).  A row is
    there if its marker or any cell is; statics stand in a row of their
    partition with null clustering keys."""
    cells = hold(cells)
    out = []
    for c, kind in classes.items():
        here = F.col("column") == c
        if kind in ("set", "list"):
            parts = F.array_sort(F.collect_list(F.when(here, F.struct("path", "value"))))
            texts = F.transform(parts, lambda p: p["path"] if kind == "set" else p["value"])
            out.append(F.when(F.size(texts) > 0, F.to_json(texts)).alias(c))
        elif kind in ("map", "udt"):
            parts = F.map_from_entries(F.array_sort(F.collect_list(F.when(here, F.struct("path", "value")))))
            out.append(F.when(F.size(parts) > 0, F.to_json(parts)).alias(c))
        else:
            out.append(F.max(F.when(here, F.col("value"))).alias(c))
    return cells.groupBy(*keys).agg(*out)

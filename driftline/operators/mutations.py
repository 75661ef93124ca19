"""Mutations of decoded rows: the fewest writes that give every cell its
writetime, expiry and deletion.

One row per mutation: the row's keys, ``op``, ``column``, ``path`` (element,
key or field), ``value`` (JSON text), ``wt``, ``expiry``, ``is_static`` and
``seq``, the order in which they would be written.  Rows without anything
special leave as one full insert and are never exploded; others are exploded
in place, so the only shuffle is the merge's.  A cell without metadata of its
own is part of the row's marker insert, or (a row without a marker) is written
at the row's newest time without expiry, nulls included.

An extension beyond cells: a row that was deleted as a whole gives one
``row_delete`` at the deletion's time, beside whatever cells it still has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.decode import TEXT_MAP, add

#: Order of writing by op.
ORDER = {"full_insert": 0, "baseline": 1, "set_group": 2, "add": 3, "field": 4, "remove": 5, "list_set": 6, "list_append": 7, "list_clear": 8, "row_delete": 9}
MUTATION = "struct<op:string,column:string,path:string,value:string,wt:bigint,expiry:bigint,is_static:boolean>"


def list_runs(values: Column, expiries: Column) -> Column:
    """Contiguous runs of equal expiry: array<struct<items, expiry>>, in order."""
    zipped = F.arrays_zip(values.alias("v"), expiries.alias("e"))
    empty = F.array().cast("array<struct<items:array<string>,expiry:bigint>>")

    def step(acc, z):
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & F.when(F.size(acc) > 0, last["expiry"].eqNullSafe(z["e"])).otherwise(F.lit(False))
        longer = F.struct(F.concat(last["items"], F.array(z["v"])).alias("items"), last["expiry"].alias("expiry"))
        return F.when(same, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(F.struct(F.array(z["v"]).alias("items"), z["e"].alias("expiry")))))

    return F.aggregate(zipped, empty, step)


def element_buckets(elements: Column, wts: Column, expiries: Column) -> Column:
    """Elements grouped by (wt, expiry), oldest first:
    array<struct<wt, expiry, items>>."""
    z = F.arrays_zip(elements.alias("v"), wts.alias("t"), expiries.alias("e"))
    pairs = F.array_sort(F.array_distinct(F.transform(z, lambda x: F.struct(x["t"].alias("wt"), x["e"].alias("expiry")))))
    return F.transform(pairs, lambda p: F.struct(p["wt"].alias("wt"), p["expiry"].alias("expiry"), F.transform(F.filter(z, lambda x: x["t"].eqNullSafe(p["wt"]) & x["e"].eqNullSafe(p["expiry"])), lambda x: x["v"]).alias("items")))


def key_removals(keys: Column, whole: Column) -> Column:
    """Removed keys newer than the whole column's deletion, grouped by time:
    array<struct<ts, keys>>."""
    newer = F.filter(keys, lambda k: k["ts"] > F.coalesce(whole, F.lit(-(2**62))))
    stamps = F.array_sort(F.array_distinct(F.transform(newer, lambda k: k["ts"])))
    return F.transform(stamps, lambda t: F.struct(t.alias("ts"), F.transform(F.filter(newer, lambda k: k["ts"] == t), lambda k: k["key"]).alias("keys")))


def removed_keys_json(keys: Column, embedded: bool = False) -> Column:
    """Removed keys as a JSON array: texts, or (frozen keys) JSON as it is."""
    return F.concat(F.lit("["), F.array_join(keys, ","), F.lit("]")) if embedded else F.to_json(keys)


#: SQL of no mutations; a time before all others.
NONE, NEVER = f"cast(array() as array<{MUTATION}>)", f"cast({-(2**62)} as bigint)"


def _text(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _one(op: str, column: str, value: str, wt: str, expiry: str, static: str, path: str = "null") -> str:
    """SQL of one mutation."""
    return f"named_struct('op', {op}, 'column', cast({column} as string), 'path', cast({path} as string), 'value', cast({value} as string), 'wt', cast({wt} as bigint), 'expiry', cast({expiry} as bigint), 'is_static', {static})"


#: SQL of contiguous runs of equal expiry: {v} are values, {e} their expiries.
RUNS = """aggregate(zip_with({v}, {e}, (v, e) -> named_struct('v', v, 'e', e)), cast(array() as array<struct<items:array<string>,expiry:bigint>>),
  (acc, z) -> if(if(size(acc) > 0, element_at(acc, -1).expiry <=> z.e, false),
    concat(slice(acc, 1, size(acc) - 1), array(named_struct('items', concat(element_at(acc, -1).items, array(z.v)), 'expiry', element_at(acc, -1).expiry))),
    concat(acc, array(named_struct('items', array(z.v), 'expiry', z.e)))))"""

#: SQL of the elements {items} of a mixed {cell} by (wt, expiry), oldest first.
BUCKETS = """if({cell}.mixed, transform(array_sort(array_distinct(transform({z}, x -> named_struct('wt', x.t, 'expiry', x.e)))), p -> named_struct('wt', p.wt, 'expiry', p.expiry,
  'items', transform(filter({z}, x -> x.t <=> p.wt and x.e <=> p.expiry), x -> x.v))), null)"""
ZIPPED = "zip_with({items}, zip_with({cell}.elem_wt, coalesce({cell}.elem_expiry, transform({cell}.elem_wt, _ -> {cell}.expiry)), (t, e) -> named_struct('t', t, 'e', e)), (v, p) -> named_struct('v', v, 't', p.t, 'e', p.e))"

#: SQL of removed keys newer than the column's own deletion, by time.
REMOVED = """transform(array_sort(array_distinct(transform(filter({d}.keys, k -> k.ts > coalesce({d}.coll_deleted_at, {never})), k -> k.ts))),
  t -> named_struct('ts', t, 'keys', transform(filter({d}.keys, k -> k.ts = t), k -> k.key)))"""


def _of_list(n: int, name: str, static: str, now: int) -> str:
    c, runs = f"_c{n}", f"_b{n}"
    op = "if(i = 0, 'list_set', 'list_append')"
    # fresh times, one per run, the same again when a batch is replayed
    each = f"transform({runs}, (r, i) -> {_one(op, name, 'to_json(r.items)', f'{now * 1_000_000} + i', 'r.expiry', static, 'i')})"
    clear = f"if({c}.d is not null, array({_one(repr('list_clear'), name, 'null', str(now * 1_000_000), 'null', static)}), {NONE})"
    return f"if({c}.v is null, {clear}, {each})"


def _of_collection(n: int, name: str, static: str, is_map: bool) -> str:
    c, b, p = f"_c{n}", f"_b{n}", f"_p{n}"
    whole = f"{c}.d.coll_deleted_at"
    items = f"map_keys({p})" if is_map else p
    implied = f"coalesce({whole} = get({b}, 0).wt - 1, false)"
    split = f"coalesce({c}.cell.mixed and size({items}) = size({c}.cell.elem_wt), false)"
    # a map's keys go with their values
    value = f"to_json(map_filter({p}, (k, _) -> array_contains(b.items, k)))" if is_map else "to_json(b.items)"
    op = f"if(i = 0 and {implied}, 'set_group', 'add')"
    adds = f"transform({b}, (b, i) -> {_one(op, name, value, 'b.wt', 'b.expiry', static)})"
    cleared = f"array({_one(repr('set_group'), name, 'null', f'{whole} + 1', 'null', static)})"
    clear = f"if({whole} is not null and not {implied}, {cleared}, {NONE})"
    uniform = f"if({c}.apart, array({_one(repr('set_group'), name, f'{c}.v', f'{c}.wt', f'{c}.expiry', static)}), {NONE})"
    removed = f"coalesce(transform({REMOVED.format(d=f'{c}.d', never=NEVER)}, r -> {_one(repr('remove'), name, 'to_json(r.keys)', 'r.ts', 'null', static)}), {NONE})"
    return f"concat(case when {c}.v is null then if({whole} is not null, {cleared}, {NONE}) when {split} then concat({clear}, {adds}) else {uniform} end, {removed})"


def _of_fields(n: int, name: str, static: str) -> str:
    c, p = f"_c{n}", f"_p{n}"
    wts, exps, whole = f"{c}.cell.field_wt", f"{c}.cell.field_expiry", f"{c}.d.coll_deleted_at"
    stamp = f"named_struct('wt', {wts}[k], 'expiry', {exps}[k])"
    oldest = f"array_min(transform(map_keys({wts}), k -> {stamp}))"
    implied = f"coalesce({whole} = {oldest}.wt - 1, false)"
    base_fields = f"map_filter({p}, (k, _) -> not map_contains_key({wts}, k) or {stamp} <=> {oldest})"
    rest = f"map_filter({p}, (k, _) -> map_contains_key({wts}, k) and (not {implied} or not ({stamp} <=> {oldest})))"
    base = f"if({implied}, array({_one(repr('set_group'), name, f'to_json({base_fields})', f'{oldest}.wt', f'{oldest}.expiry', static)}), {NONE})"
    single = f"transform(map_entries({rest}), e -> {_one(repr('field'), name, 'e.value', f'{wts}[e.key]', f'{exps}[e.key]', static, 'e.key')})"
    group = f"array({_one(repr('set_group'), name, f'{c}.v', f'{c}.wt', f'{c}.expiry', static)})"
    nulls = f"coalesce(transform(filter({c}.d.keys, k -> k.ts > coalesce({whole}, {NEVER})), k -> {_one(repr('field'), name, 'null', 'k.ts', 'null', static, 'k.key')}), {NONE})"
    return f"concat(case when {c}.cell.mixed then concat({base}, {single}) when {c}.apart and {c}.v is not null then {group} else {NONE} end, {nulls})"


def _of_value(n: int, name: str, static: str) -> str:
    c = f"_c{n}"
    set_to = lambda value, wt, expiry: f"array({_one(repr('set_group'), name, value, wt, expiry, static)})"
    return f"case when {c}.v is null and {c}.d is not null then {set_to('null', f'{c}.d.deleted_at', 'null')} when {c}.apart then {set_to(f'{c}.v', f'{c}.wt', f'{c}.expiry')} else {NONE} end"


def plan(decoded: DataFrame, kinds: dict[str, str], classes: dict[str, str], now: int) -> DataFrame:
    """Mutations of decoded rows (clean, marker, cells, deletions).

    ``kinds``: column to partition_key, clustering, regular or static.
    ``classes``: column to simple, frozen, list, set, map or udt.
    """
    parse = {"list": "array<string>", "set": "array<string>", "map": TEXT_MAP, "udt": TEXT_MAP}
    kept = [c for c in decoded.columns if c != "json"]
    keys = [c for c, k in kinds.items() if k in ("partition_key", "clustering")]
    data = [c for c, k in kinds.items() if k in ("regular", "static")]
    among = lambda x, names: f"{x} in ({', '.join(map(_text, names))})" if names else "false"
    no_row = " or ".join(["false", *[f"clean[{_text(c)}] is null" for c, k in kinds.items() if k == "clustering"]])
    deleted = "row_deleted_at" if "row_deleted_at" in kept else "cast(null as bigint)"
    rows = add(decoded.select(*kept), {"_static_only": no_row, "_writes_row": f"marker is not null and not ({no_row})", "_row_wt": f"coalesce(latest_wt, {now * 1_000_000})"})
    # what a column has to say, and its parts, parsed once a row
    facts, parsed = {}, {}
    for n, c in enumerate(data):
        q = _text(c)
        own = f"map_contains_key(cells, {q})"
        facts[f"_c{n}"] = f"""named_struct('v', clean[{q}], 'cell', cells[{q}], 'd', deletions[{q}], 'apart', {own} or (map_contains_key(clean, {q}) and not _writes_row),
          'wt', case when {own} then cells[{q}].wt when clean[{q}] is null then _row_wt else coalesce(marker.wt, _row_wt) end,
          'expiry', case when {own} then cells[{q}].expiry when clean[{q}] is not null then marker.expiry end)"""
        if classes[c] in parse:
            parsed[f"_p{n}"] = f"from_json(clean[{q}], '{parse[classes[c]]}')"
    rows = add(rows, facts | parsed)
    grouped_parts = {}
    for n, c in enumerate(data):
        cell = f"_c{n}.cell"
        if classes[c] == "list":
            size = f"greatest(size(_p{n}), 1)"
            grouped_parts[f"_b{n}"] = RUNS.format(v=f"_p{n}", e=f"slice(coalesce({cell}.elem_expiry, transform(sequence(1, {size}), _ -> _c{n}.expiry)), 1, {size})")
        elif classes[c] in ("set", "map"):
            grouped_parts[f"_b{n}"] = BUCKETS.format(cell=cell, z=ZIPPED.format(cell=cell, items=f"map_keys(_p{n})" if classes[c] == "map" else f"_p{n}"))
    rows = add(rows, grouped_parts) if grouped_parts else rows
    extra = []
    for n, c in enumerate(data):
        static, name, kind = str(kinds[c] == "static").lower(), _text(c), classes[c]
        if kind == "list":
            out = _of_list(n, name, static, now)
        elif kind in ("set", "map"):
            out = _of_collection(n, name, static, kind == "map")
        else:
            out = _of_fields(n, name, static) if kind == "udt" else _of_value(n, name, static)
        extra.append(f"coalesce({out if kinds[c] == 'static' else f'if(_static_only, {NONE}, {out})'}, {NONE})")
    plain = f"size(cells) = 0 and coalesce(size(deletions), 0) < 1 and _writes_row and {deleted} is null and {str('list' not in classes.values()).lower()}"
    scalars, lists = ([c for c in data if classes[c] in of] for of in (("simple", "frozen"), ("list",)))
    every = f"concat({', '.join(extra)})" if extra else NONE
    rows = add(rows, {"_extra": f"if({plain}, {NONE}, {every})"}, (*facts, *parsed, *grouped_parts))
    in_row = f"(v is not null or {among('k', scalars)} and not coalesce(map_contains_key(deletions, k), false))"
    shared = f"map_filter(clean, (k, v) -> {among('k', keys)} or ({among('k', data)} and {in_row} and not map_contains_key(cells, k) and not {among('k', lists)}))"
    row_write = lambda op, text: f"array({_one(repr(op), 'null', f'to_json({text})', 'marker.wt', 'marker.expiry', 'false')})"
    first = f"case when _writes_row and {deleted} is null and size(_extra) = 0 then {row_write('full_insert', 'clean')} when _writes_row then {row_write('baseline', shared)} else {NONE} end"
    last = f"if({deleted} is not null, array({_one(repr('row_delete'), 'null', 'null', deleted, 'null', 'false')}), {NONE})"
    left = [c for c in kept if c not in ("clean", "marker", "cells", "all_cells", "deletions", "row_deleted_at", "latest_wt")]
    seq = "map(" + ", ".join(f"'{op}', {n}" for op, n in ORDER.items()) + ")"
    out = rows.select(*left, F.explode(F.expr(f"concat({first}, _extra, {last})")).alias("m"))
    return out.select(*left, "m.*", F.expr(f"{seq}[m.op]").alias("seq"))


def grouped(mutations: DataFrame, keys: list[str]) -> DataFrame:
    """Cells written together: set_group mutations by (wt, expiry, is_static)."""
    cells = mutations.where("op = 'set_group'")
    return cells.groupBy(*keys, "wt", "expiry", "is_static").agg(F.array_sort(F.collect_list("column")).alias("columns"))

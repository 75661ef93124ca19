"""Row envelopes: a JSON row with members that describe its cells.

An envelope is one JSON object.  Members named ``__sys_*`` are metadata: the
row marker's writetime (``__sys_rw_ts``) and [duration, offset]
(``__sys_rw_ttl``), cell writetimes (``__sys_clts``), cell TTLs
(``__sys_clttl``: [base, details]) and deletions (``__sys_clts_tmbstn``).  A
cell's entry is a number, an array (one per element) or an object (one per
key or field).  A row may also be deleted as a whole (``__sys_rw_tmbstn``).

A text is parsed twice, in one narrow pass: to VARIANT, which types the
metadata and tells what is malformed, and, if it is well formed, to a map of
texts, which keeps values as they were written.  What was parsed is held before
its many uses (see ``hold``).  No step depends on the length of a text but by
reading it.  Expressions are SQL text, which the JVM parses at once; built call
by call they cost the driver seconds.  ``now`` is a parameter.

Rejected, each with a reason: texts that are not one object (also those that
name a member twice), and metadata of the row marker, its TTL and the cells'
TTLs that is not of the stated form.  Writetimes and deletions of odd form are
tolerated: of a writetime the newest whole number counts, a deletion without
one is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "__sys_"
TEXT_MAP = "map<string,string>"

#: SQL of a VARIANT ``{x}``: its type, and whether it is a list or an object.
KIND, IS_LIST, IS_OBJECT = "schema_of_variant({x})", "startswith(schema_of_variant({x}), 'ARRAY<')", "startswith(schema_of_variant({x}), 'OBJECT<')"
LIST, OBJECT = "try_cast({x} as array<variant>)", "try_cast({x} as map<string,variant>)"
WHOLE = "if(schema_of_variant({x}) = 'BIGINT', variant_get({x}, '$', 'bigint'), null)"
#: Two whole numbers.
PAIR = "(schema_of_variant({x}) = 'ARRAY<BIGINT>' and size(try_cast({x} as array<bigint>)) = 2 and not exists(try_cast({x} as array<bigint>), n -> n is null))"
GIVEN = "({x} is not null and not is_variant_null({x}))"
#: A map whose keys may be quoted identifiers, with their plain names.
UNQUOTED = "if(exists(map_keys({x}), k -> startswith(k, '\"')), transform_keys({x}, (k, _) -> if(length(k) > 1 and startswith(k, '\"') and endswith(k, '\"'), replace(substring(k, 2, length(k) - 2), '\"\"', '\"'), k)), {x})"

#: A writetime entry: newest whole number, and elements' or fields' writetimes.
WRITETIME = """named_struct(
  'wt', case when {kind} = 'BIGINT' then variant_get(x, '$', 'bigint')
             when {is_list} then array_max(transform({list}, e -> case when {list_in_e} then array_max(transform(try_cast(e as array<variant>), n -> {whole_n})) else {whole_e} end))
             when {is_object} then array_max(transform(map_values({object}), e -> {whole_e})) end,
  'elem_wt', if({kind} in ('ARRAY<BIGINT>', 'ARRAY<VOID>'), try_cast(x as array<bigint>), null),
  'field_wt', if({is_object} and not exists(map_values({object}), e -> schema_of_variant(e) not in ('BIGINT', 'VOID')), map_filter(try_cast(x as map<string,bigint>), (_, t) -> t is not null), null))"""

#: What a TTL detail is: lone (a pair), many (one per element), fields, none, or
#: the fault it has.
DETAIL_SHAPE = """case when {kind} = 'VOID' or {kind} = 'ARRAY<VOID>' and size({list}) = 0 then 'none'
  when {is_object} then 'fields' when not {is_list} then 'cell ttl detail'
  when {first_is_list} then 'many' when {first} = 'BIGINT' or {first} like 'DECIMAL%' or {first} in ('DOUBLE', 'FLOAT') then 'lone' else 'cell ttl start' end"""

#: A deletion entry: number, [whole column's, {key: time}], or {key: time}.
DELETION = """named_struct('simple', {whole},
  'whole', if({is_list}, {whole_first}, null),
  'keyed', case when {is_object} then {object} when {is_list} then get(filter(transform({list}, e -> try_cast(e as map<string,variant>)), o -> o is not null), 0) end)"""


def _of(template: str, x: str, **more: str) -> str:
    """``template`` with the SQL pieces above for ``x``."""
    first = f"get({LIST.format(x=x)}, 0)"
    return template.format(
        x=x, kind=KIND.format(x=x), is_list=IS_LIST.format(x=x), is_object=IS_OBJECT.format(x=x), list=LIST.format(x=x), object=OBJECT.format(x=x), whole=WHOLE.format(x=x),
        first=KIND.format(x=first), first_is_list=IS_LIST.format(x=first), whole_first=WHOLE.format(x=first), list_in_e=IS_LIST.format(x="e"), whole_e=WHOLE.format(x="e"), whole_n=WHOLE.format(x="n"), **more)


def hold(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed here, once a row.  The optimizer copies
    a column's expression into every use above it, also into lambdas, where it
    would run once an element; it does not look through a generator."""
    return df.select(F.inline(F.array(F.struct("*"))))


def add(df: DataFrame, columns: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with columns of SQL text, held (see ``hold``), less ``drop``."""
    fields = {c: "`" + c.replace("`", "``") + "`" for c in df.columns if c not in drop} | columns
    name = lambda c: "'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return df.selectExpr("inline(array(named_struct(" + ", ".join(f"{name(c)}, {text}" for c, text in fields.items()) + ")))")


#: Of each TTL detail: an element or field that is no list, a pair that is no
#: pair, a negative duration.
FAULTS = {
    "cell ttl element": "d.shape = 'many' and exists(d.pairs, p -> not startswith(schema_of_variant(p), 'ARRAY<'))",
    "cell ttl field": "d.shape = 'fields' and exists(d.pairs, p -> schema_of_variant(p) <> 'VOID' and not startswith(schema_of_variant(p), 'ARRAY<'))",
    "cell ttl pair": "d.shape in ('lone', 'many', 'fields') and exists(d.pairs, p -> schema_of_variant(p) <> 'VOID' and not " + PAIR.format(x="p") + ")",
    "negative cell ttl": "d.shape in ('lone', 'many', 'fields') and exists(d.pairs, p -> get(try_cast(p as array<bigint>), 0) < 0)",
}


def parsed(envelopes: DataFrame, json: str = "json") -> DataFrame:
    """``envelopes`` with ``reason`` (null if well formed), ``top`` (members as
    texts) and the metadata: ``mark``, ``mark_ttl``, ``ttl_base``,
    ``writetimes``, ``ttls``, ``deletions``, ``row_deleted_at`` and
    ``odd_newest`` (of writetimes that are no object)."""
    text = f"`{json}`"
    # one more element closes what a text may have left open or gone on with
    rows = add(envelopes, {"_doc": f"try_cast(try_parse_json(concat('[', {text}, ',0]')) as array<variant>)"})
    rows = add(rows, {"_m": "if(size(_doc) = 2, try_cast(get(_doc, 0) as map<string,variant>), null)"}, ("_doc",))
    member = lambda name: f"_m['__sys_{name}']"
    clttl, clts, tombs, ttl = member("clttl"), member("clts"), member("clts_tmbstn"), member("rw_ttl")
    details = f"try_cast(get(filter({LIST.format(x=clttl)}, (x, i) -> i > 0 and {IS_OBJECT.format(x='x')}), 0) as map<string,variant>)"
    rows = add(rows, {
        "_mark": member("rw_ts"), "_ttl": ttl, "_clttl": clttl, "_row_del": member("rw_tmbstn"), "_clts": clts,
        "_times": f"try_cast({clts} as map<string,variant>)", "_details": details, "_tombs": f"try_cast({tombs} as map<string,variant>)", "_object": "_m is not null",
    }, ("_m",))
    odd = f"case when _times is not null then null when {IS_LIST.format(x='_clts')} then array_max(transform({LIST.format(x='_clts')}, e -> {WHOLE.format(x='e')})) else {WHOLE.format(x='_clts')} end"
    detail = "transform_values(" + UNQUOTED.format(x="_details") + ", (_, x) -> named_struct('x', x, 'shape', " + _of(DETAIL_SHAPE, "x") + "))"
    rows = add(rows, {
        "mark": WHOLE.format(x="_mark"),
        "mark_ttl": f"if({PAIR.format(x='_ttl')}, try_cast(_ttl as array<bigint>), null)",
        "ttl_base": f"if({IS_LIST.format(x='_clttl')}, {WHOLE.format(x='get(try_cast(_clttl as array<variant>), 0)')}, null)",
        "writetimes": "transform_values(" + UNQUOTED.format(x="_times") + ", (_, x) -> " + _of(WRITETIME, "x") + ")",
        "_shapes": detail,
        "_dels": "transform_values(" + UNQUOTED.format(x="_tombs") + ", (_, x) -> " + _of(DELETION, "x") + ")",
        "row_deleted_at": WHOLE.format(x="_row_del"),
        "odd_newest": odd,
    }, ("_times", "_details", "_tombs", "_clts", "_row_del"))
    pairs = "case d.shape when 'lone' then array(d.x) when 'many' then try_cast(d.x as array<variant>) when 'fields' then map_values(try_cast(d.x as map<string,variant>)) end"
    keyed = f"transform(filter(map_entries(d.keyed), e -> {WHOLE.format(x='e.value')} is not null), e -> named_struct('key', e.key, 'ts', {WHOLE.format(x='e.value')}))"
    rows = add(rows, {
        "_parts": f"transform_values(_shapes, (_, d) -> named_struct('shape', d.shape, 'names', if(d.shape = 'fields', map_keys(try_cast(d.x as map<string,variant>)), null), 'pairs', {pairs}))",
        "_dels": f"transform_values(_dels, (_, d) -> named_struct('simple', d.simple, 'whole', d.whole, 'keys', coalesce({keyed}, array())))",
    }, ("_shapes",))
    whole_text = f"btrim({text}, ' \\t\\n\\r')"
    faults = " ".join(f"when exists(map_values(_parts), d -> {test}) then '{name}'" for name, test in FAULTS.items())
    reason = f"""case
      when not _object then if(startswith({whole_text}, '{{') and endswith({whole_text}, '}}') and {IS_OBJECT.format(x=f'try_parse_json({text})')}, 'trailing text', 'not an object')
      when {GIVEN.format(x='_mark')} and {KIND.format(x='_mark')} <> 'BIGINT' then 'marker'
      when {GIVEN.format(x='_ttl')} and mark_ttl is null then 'ttl pair'
      when mark_ttl[0] < 0 then 'negative ttl'
      when {GIVEN.format(x='_clttl')} and not {IS_LIST.format(x='_clttl')} then 'cell ttl shape'
      when {IS_LIST.format(x='_clttl')} and size({LIST.format(x='_clttl')}) > 0 and ttl_base is null then 'cell ttl base'
      when exists(map_values(_parts), d -> d.shape = 'cell ttl detail') then 'cell ttl detail'
      when exists(map_values(_parts), d -> d.shape = 'cell ttl start') then 'cell ttl start'
      {faults} end"""
    newest = "greatest(d.simple, d.whole, array_max(transform(d.keys, k -> k.ts)))"
    rows = add(rows, {
        "reason": reason,
        "ttls": "transform_values(map_filter(_parts, (_, d) -> d.shape in ('lone', 'many', 'fields')), (_, d) -> named_struct('shape', d.shape, 'names', d.names, 'pairs', transform(d.pairs, p -> try_cast(p as array<bigint>))))",
        "deletions": f"map_filter(transform_values(_dels, (_, d) -> named_struct('deleted_at', {newest}, 'is_complex', d.simple is null, 'coll_deleted_at', d.whole, 'keys', d.keys)), (_, d) -> d.deleted_at is not null)",
    }, ("_mark", "_ttl", "_clttl", "_parts", "_dels", "_object"))
    return add(rows, {"top": f"if(reason is null, from_json({text}, '{TEXT_MAP}'), null)"})


#: What parsed() adds beside the reason.
PARSED = ("top", "mark", "mark_ttl", "ttl_base", "writetimes", "ttls", "deletions", "row_deleted_at", "odd_newest")


def split_malformed(envelopes: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(good, quarantined with a ``reason``)."""
    rows = parsed(envelopes, json)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").drop(*PARSED)


def strip_system(top: Column) -> Column:
    return F.map_filter(top, lambda k, _: ~F.startswith(k, F.lit(SYSTEM)))


def _expiry(p: str, base: str, now: int) -> str:
    """Expiry second of a [duration, offset] pair."""
    return f"case when {p} is null or {p}[0] <= 0 then null when {base} + {p}[1] > 0 then {base} + {p}[1] else {now} + {p}[0] end"


def expiries(now: int, ttls: str = "ttls", base: str = "coalesce(ttl_base, 0)") -> str:
    """SQL of each column's expiry: of a pair, of each element, or each field."""
    at = f"transform(d.pairs, p -> {_expiry('p', base, now)})"
    return f"""transform_values({ttls}, (_, d) -> named_struct('expiry', if(d.shape = 'lone', get({at}, 0), null), 'elem_expiry', if(d.shape = 'many', {at}, null),
      'field_expiry', if(d.shape = 'fields', map_from_arrays(d.names, {at}), null)))"""


#: SQL of the latest of some expiries; one that never comes wins.
LONGEST = "if(exists({x}, t -> t is null), null, array_max({x}))"


def decode(envelopes: DataFrame, now: int, json: str = "json") -> DataFrame:
    """Well-formed envelopes with ``clean`` (members as texts), ``marker`` (wt,
    expiry; null without one), ``all_cells``, ``cells``, ``deletions``,
    ``row_deleted_at`` and ``latest_wt``.

    A cell that is uniform inside has one (wt, expiry); only others keep
    element or field arrays.  ``cells`` holds those that differ from the marker.
    A cell without TTL detail has the marker's expiry.  Containers whose
    writetime is null become null.
    """
    good, _ = split_malformed(envelopes, json)
    base = "coalesce(ttl_base, 0)"
    rows = add(good, {
        "marker": f"if(mark is null, null, named_struct('wt', mark, 'expiry', {_expiry('mark_ttl', base, now)}))",
        "_exp": expiries(now),
        "clean": f"map_filter(top, (k, _) -> not startswith(k, '{SYSTEM}'))",
    }, ("top", "mark", "mark_ttl", "ttl_base", "ttls"))
    rows = add(rows, {
        # each live cell with its expiries laid out like its writetimes
        "_live": """transform_values(map_filter(writetimes, (_, w) -> w.wt is not null), (k, w) -> named_struct('w', w, 'given', _exp[k] is not null, 'expiry', _exp[k].expiry,
          'elem_e', if(w.elem_wt is null, null, coalesce(_exp[k].elem_expiry, transform(w.elem_wt, _ -> _exp[k].expiry))),
          'field_e', if(w.field_wt is null, null, coalesce(_exp[k].field_expiry, transform_values(w.field_wt, (_, t) -> _exp[k].expiry)))))""",
        "clean": "transform_values(clean, (k, v) -> if(map_contains_key(coalesce(writetimes, map()), k) and writetimes[k].wt is null and writetimes[k].elem_wt is null and substring(ltrim(v), 1, 1) in ('[', '{'), null, v))",
        "latest_wt": "greatest(marker.wt, odd_newest, array_max(transform(map_values(writetimes), w -> w.wt)))",
    }, ("_exp", "writetimes", "odd_newest"))
    elements = "array_distinct(transform(arrays_zip(c.w.elem_wt, c.elem_e), z -> struct(z.elem_wt, z.elem_e)))"
    fields = "array_distinct(transform(map_entries(c.w.field_wt), z -> struct(z.value, c.field_e[z.key])))"
    longest = f"case when not c.given then marker.expiry when c.elem_e is not null then {LONGEST.format(x='c.elem_e')} when c.field_e is not null then {LONGEST.format(x='map_values(c.field_e)')} else c.expiry end"
    rows = add(rows, {"_live": f"transform_values(_live, (_, c) -> named_struct('c', c, 'expiry', {longest}, 'mixed', coalesce(size({elements}) > 1, false) or coalesce(size({fields}) > 1, false)))"})
    cell = "named_struct('wt', x.c.w.wt, 'expiry', x.expiry, 'mixed', x.mixed, 'elem_wt', if(x.mixed, x.c.w.elem_wt, null), 'elem_expiry', if(x.mixed, x.c.elem_e, null), 'field_wt', if(x.mixed, x.c.w.field_wt, null), 'field_expiry', if(x.mixed, x.c.field_e, null))"
    rows = add(rows, {"all_cells": f"transform_values(_live, (_, x) -> {cell})"}, ("_live",))
    return add(rows, {"cells": "map_filter(all_cells, (_, c) -> marker is null or c.mixed or not (c.wt <=> marker.wt and c.expiry <=> marker.expiry))"})


def cell_metadata(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, col, value, wt: a row for each of ``columns`` that a decoded
    row holds, with its cell's writetime (null where none is known)."""
    long = rows.select(*keys, "all_cells", F.explode("clean").alias("col", "value")).where(F.col("col").isin(columns))
    own = F.col("all_cells")[F.col("col")]
    return long.select(*keys, "col", "value", own["wt"].alias("wt"))

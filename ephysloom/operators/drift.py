"""Schemas that drift between files.

Every payload (a JSON object) becomes path-value rows with raw types; path-type
statistics are aggregated by file (map-side combined, so a file or series of
any size costs its distinct names only); successive files are compared; and the
typed table is projected with every failed cast reported.

Flat objects without escapes - nearly all rows - are tokenised by regular
expressions inside the JVM, where the raw spelling of numbers is still visible;
all quantifiers are possessive, so the match runs in constant stack whatever the
number of fields.  Only objects that are nested, escaped or malformed go through
an Arrow-batched Python parser; both ways follow the JSON grammar and give the
same result.

Defined results: a null, empty or malformed payload holds no field but its file
still counts as a file; a field of which all values are null is an ``int``;
a nested object or array is one value of its name, kept as JSON text, of type
``int`` in the sense of the type rule (neither string, boolean nor decimal
number), and its leaves are further values under dotted paths (``depth`` above 0)
that count as no field of the file; repeated lines change nothing; a name that
appears twice in one object counts with both values, and the typed table takes
the first that is not null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_VALUE = r'"[^"\\\x00-\x1f]*+"|-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+|true|false|null'
_PAIR = rf'"([^"\\\x00-\x1f]*+)"\s*+:\s*+({_VALUE})'
_ONE = rf'"[^"\\\x00-\x1f]*+"\s*+:\s*+(?:{_VALUE})\s*+'
_FLAT = rf"^\s*+\{{\s*+(?:{_ONE}(?:,\s*+{_ONE})*+)?+\}}\s*+$"


def plain_name(c: Column) -> Column:
    """Lower case, reduced to a-z and 0-9."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


class _Number(str):
    """A JSON number in its raw spelling."""


class _Pairs(list):
    """A JSON object as its pairs, so that a name given twice is seen twice."""


def _plain(v) -> object:
    """The value as Python's own types, for writing it back as text."""
    if isinstance(v, _Pairs):
        return {n: _plain(x) for n, x in v}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, _Number):
        return float(v) if any(c in v for c in ".eE") else int(v)
    return v


def _refuse(text: str):
    raise ValueError(f"{text} is no JSON number")


def flatten_json(payload: str | None) -> list[tuple[str, str | None, str, int]]:
    """(path, text, raw type, depth) of every value; malformed payloads have none.

    Raw types: text, bool, float (a number written with a decimal point), int,
    null, array, object.
    """
    try:
        top = json.loads(payload or "", parse_float=_Number, parse_int=_Number, parse_constant=_refuse, object_pairs_hook=_Pairs)
    except (ValueError, RecursionError):
        return []
    if not isinstance(top, _Pairs):
        return []
    out: list[tuple[str, str | None, str, int]] = []
    todo = [("", top, 0)]
    while todo:
        prefix, pairs, depth = todo.pop(0)
        for name, v in pairs:
            path = f"{prefix}{name}"
            if isinstance(v, _Number):
                out.append((path, str(v), "float" if "." in v else "int", depth))
            elif isinstance(v, str):
                out.append((path, v, "text", depth))
            elif isinstance(v, bool):
                out.append((path, "true" if v else "false", "bool", depth))
            elif v is None:
                out.append((path, None, "null", depth))
            else:
                out.append((path, json.dumps(_plain(v)), "object" if isinstance(v, _Pairs) else "array", depth))
                if isinstance(v, _Pairs):
                    todo.append((path + ".", v, depth + 1))
    return out


LEAVES = "array<struct<name:string,value:string,type:string,depth:int>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("type", pa.string()), ("depth", pa.int32())]))
    for b in batches:
        leaves = [[{"name": n, "value": v, "type": t, "depth": d} for n, v, t, d in flatten_json(x)] for x in b.column("payload").to_pylist()]
        rest = [b.column(i) for i in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(leaves, kind)], names=[*b.schema.names[:-1], "leaves"])


def path_values(df: DataFrame, keys: Sequence[str], payload: str = "payload", once: bool = False) -> DataFrame:
    """``*keys, leaves array<struct<name,value,type,depth>>``, one row per
    input row, or with ``once`` per distinct keys and payload."""
    src = df.select(*keys, F.col(payload).alias("payload"))
    src = src.distinct() if once else src
    src = src.withColumn("__flat", F.coalesce(F.col("payload").rlike(_FLAT), F.lit(False)))
    flat = src.filter("__flat")
    names = F.regexp_extract_all("payload", F.lit(_PAIR), F.lit(1))
    values = F.regexp_extract_all("payload", F.lit(_PAIR), F.lit(2))
    first = lambda v: F.substring(v, 1, 1)
    leaf = lambda n, v: F.struct(
        n.alias("name"),
        F.when(v == "null", None).when(first(v) == '"', F.regexp_replace(v, '^"|"$', "")).otherwise(v).alias("value"),
        F.when(first(v) == '"', "text").when(v == "null", "null").when(v.isin("true", "false"), "bool").when(v.contains("."), "float").otherwise("int").alias("type"),
        F.lit(0).alias("depth"),
    )
    flat = flat.select(*keys, F.zip_with(names, values, leaf).alias("leaves"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    rest = src.filter("not __flat").select(*keys, "payload").mapInArrow(_parse, f"{kind}, leaves {LEAVES}")
    return flat.unionByName(rest)


def field_stats(rows: DataFrame, keys: Sequence[str], known: DataFrame) -> DataFrame:
    """Path-type statistics by file: ``*keys, field, plains, type, n_rows, n_values``.

    ``rows`` has ``leaves``; ``known`` maps ``known_name`` to ``field``.  Names
    are grouped raw first (map-side), and only the few distinct ones normalised.
    """
    k = list(keys)
    leaf = rows.select(*k, F.explode("leaves").alias("x")).filter("x.depth = 0").select(*k, "x.name", "x.type")
    raw = leaf.groupBy(*k, "name").agg(
        F.max((F.col("type") == "text").cast("int")).alias("t"),
        F.max((F.col("type") == "bool").cast("int")).alias("b"),
        F.max((F.col("type") == "float").cast("int")).alias("f"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum((F.col("type") != "null").cast("long")).alias("n_values"),
    )
    names = known.select(plain_name(F.col("known_name")).alias("plain"), "field").groupBy("plain").agg(F.min("field").alias("known"))
    raw = raw.withColumn("plain", plain_name(F.col("name"))).join(names, "plain", "left").withColumn("field", F.coalesce("known", "plain"))
    return raw.groupBy(*k, "field").agg(
        F.array_sort(F.collect_set("plain")).alias("plains"),
        F.when(F.max("t") == 1, "text").when(F.max("b") == 1, "bool").when(F.max("f") == 1, "float").otherwise("int").alias("type"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_values").alias("n_values"),
    )


def file_order(df: DataFrame, series: str, file: str, written: str) -> DataFrame:
    """Per series the files in order of writing: ``series, file, no, next_file, n_files``."""
    files = df.groupBy(series, file).agg(F.min(written).alias("__w"))
    w = W.partitionBy(series).orderBy("__w", file)
    return files.select(
        series, file, F.row_number().over(w).alias("no"), F.lead(file).over(w).alias("next_file")
    )


def schema_changes(stats: DataFrame, files: DataFrame, series: str, file: str) -> DataFrame:
    """Changes between successive files: ``series, file, field, change, old, new``.

    One window per (series, field) over the files that hold it: a hole in the
    ordinals is a removal followed by an addition, neighbours are compared.
    """
    d = stats.join(files, [series, file])
    w = W.partitionBy(series, "field").orderBy("no")
    for c in ("no", "plains", "type"):
        d = d.withColumn(f"p_{c}", F.lag(c).over(w))
    d = d.withColumn("n_no", F.lead("no").over(w))
    shown = F.concat(F.array_join("plains", "+"), F.lit(":"), F.col("type"))
    name, before = F.array_join("plains", "+"), F.array_join("p_plains", "+")
    follows = F.col("p_no") == F.col("no") - 1
    none = F.lit(None).cast("string")
    row = lambda cond, at, change, old, new: F.when(cond, F.struct(at.alias("file"), F.lit(change).alias("change"), old.alias("old"), new.alias("new")))
    rows = F.array(
        row((F.col("no") > 1) & ~F.coalesce(follows, F.lit(False)), F.col(file), "added", none, shown),
        row(F.col("next_file").isNotNull() & ~F.coalesce(F.col("n_no") == F.col("no") + 1, F.lit(False)), F.col("next_file"), "removed", shown, none),
        row(follows & (name != before), F.col(file), "renamed", before, name),
        row(follows & (F.col("type") != F.col("p_type")), F.col(file), "retyped", F.col("p_type"), F.col("type")),
    )
    return d.select(F.col(series).alias("series"), "field", F.explode(F.array_compact(rows)).alias("x")).select("series", F.col("x.file").alias("file"), "field", "x.change", "x.old", "x.new")


def to_long(v: Column) -> Column:
    """Whole number out of raw text: digit groups, a unit and ``.0`` allowed.

    A number with a fraction is no sample index: null (reported as failed).
    """
    t = F.trim(F.regexp_replace(v, r"\s*[A-Za-zµ]+\s*$", ""))
    t = F.when(t.rlike(r"^-?\d{1,3}(,\d{3})+$"), F.regexp_replace(t, ",", "")).otherwise(t)
    t = F.regexp_replace(t, r"\.0*$", "")
    return F.when(t.rlike(r"^-?\d{1,18}$"), t.try_cast("long"))


def to_double(v: Column) -> Column:
    """Decimal number out of raw text: decimal comma and a unit allowed."""
    t = F.trim(F.regexp_replace(v, r"\s*[A-Za-zµ]+\s*$", ""))
    t = F.when(t.rlike(r"^-?\d+,\d+$"), F.regexp_replace(t, ",", ".")).otherwise(t)
    return F.when(t.rlike(r"^-?\d+(\.\d*)?([eE][+-]?\d+)?$"), t.try_cast("double"))


CASTS = {"long": to_long, "double": to_double, "string": lambda v: v}


def typed_rows(rows: DataFrame, keys: Sequence[str], known: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One typed row per input row: ``*keys, <fields>, extra, failed``.

    ``fields`` maps each canonical field to long, double or string.  ``extra``
    holds all other names as a map, ``failed`` the fields whose value was given
    but could not be cast (their raw text in the form ``field=text``).
    Known names are a fixed dictionary; it is folded into one map column.
    """
    k = list(keys)
    names = known.filter(F.col("field").isin(list(fields))).select(plain_name(F.col("known_name")).alias("plain"), "field").groupBy("plain").agg(F.min("field").alias("field"))
    lookup = names.agg(F.map_from_entries(F.collect_list(F.struct("plain", "field"))).alias("__names"))
    d = rows.join(F.broadcast(lookup))
    plain = lambda x: F.when(x["depth"] == 0, plain_name(x["name"])).otherwise(F.lower(x["name"]))
    leaf = lambda x: F.struct(F.coalesce(F.when(x["depth"] == 0, F.col("__names")[plain_name(x["name"])]), plain(x)).alias("f"), x["value"].alias("v"))
    d = d.withColumn("__l", F.filter(F.transform("leaves", leaf), lambda x: x["v"].isNotNull()))
    held = lambda name: F.get(F.filter("__l", lambda x: x["f"] == name), F.lit(0))["v"]
    raw = {f: held(f) for f in fields}
    d = d.select(*k, "__l", *[v.alias(f"__raw_{f}") for f, v in raw.items()])
    cast = {f: CASTS[t](F.col(f"__raw_{f}")) for f, t in fields.items()}
    failed = F.array_compact(F.array(*[F.when(F.col(f"__raw_{f}").isNotNull() & cast[f].isNull(), F.concat(F.lit(f"{f}="), F.col(f"__raw_{f}"))) for f in fields]))
    other = F.filter("__l", lambda x: ~x["f"].isin(list(fields)))
    extra = F.to_json(F.map_from_entries(F.array_sort(F.transform(F.array_distinct(F.transform(other, lambda x: x["f"])), lambda n: F.struct(n.alias("k"), F.get(F.filter(other, lambda y: y["f"] == n), F.lit(0))["v"].alias("v"))))))
    return d.select(*k, *[cast[f].alias(f) for f in fields], extra.alias("extra"), failed.alias("failed"))

"""Small column expressions: absent values, integers, maps, plurals, times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text(col: Column) -> Column:
    """String form in which absent is the empty string."""
    return F.coalesce(col.cast("string"), F.lit(""))


def strict_int(col: Column, kind: str = "bigint") -> Column:
    """Integer of a plain digit string; null for blanks, decimals and overflow."""
    return F.when(col.rlike(r"^[+-]?[0-9]+$"), col.try_cast(kind))


def option(meta: str, key: str) -> Column:
    """Value of ``key`` in a map column; an exact spelling wins over another letter case."""
    return F.expr(
        f"coalesce(try_element_at({meta}, '{key}'),"
        f" get(filter(array_sort(map_entries({meta})), e -> lower(e.key) = '{key.lower()}'), 0).value)"
    )


def sorted_entries(m: Column) -> Column:
    # keys differ and no entry is null, so this is the order of ``array_sort``, whose comparison is not compiled
    return F.sort_array(F.map_entries(m))


def maps_equal(a: Column, b: Column) -> Column:
    """Order-insensitive map equality; two nulls are equal."""
    return sorted_entries(a).eqNullSafe(sorted_entries(b))


def map_text(m: Column) -> Column:
    """Map as ``k=v`` pairs in key order, for display and comparison."""
    pairs = F.transform(sorted_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(pairs, ",")


def overlay(base: Column, top: Column) -> Column:
    """Union of two maps in which ``top`` wins on equal keys."""
    keep = F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k))
    return F.map_concat(keep, top)


def overlay_named(base: Column, names: list[str], keys: Column, values: Column) -> Column:
    """:func:`overlay` by the entries of ``keys``, which are some of ``names``, and ``values``; one map is built unless ``base`` has such a name."""
    clash = reduce(Column.__or__, [F.array_contains(F.map_keys(base), n) for n in names])
    whole = F.map_from_arrays(F.concat(F.map_keys(base), keys), F.concat(F.map_values(base), values))
    return F.when(clash, overlay(base, F.map_from_arrays(keys, values))).otherwise(whole)


def fingerprint(*cols: Column) -> Column:
    """Hash of plain columns; pass maps through :func:`sorted_entries` first."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def canonical(col: Column, kind: T.DataType) -> Column:
    """The value with every map inside as entries in key order, so that equal objects have equal text."""
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(col))
        return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType).alias("value")))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [canonical(col[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    return col


def object_fingerprint(df: DataFrame, columns: list[str]) -> Column:
    """Digest of whole objects: the same for maps in another order, another one for any change."""
    parts = [canonical(F.col(c), df.schema[c].dataType).alias(c) for c in columns]
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def int_div(x: Column, d: Column) -> Column:
    return F.call_function("div", x, d)


def ceil_div(x: Column, d: Column) -> Column:
    """Ceiling of x / d for non-negative bigint x and positive d."""
    return int_div(x + d - F.lit(1), d)


def plural(kind: Column) -> Column:
    """Lower-case English plural of a resource kind."""
    k = F.lower(kind)
    # Fixed spelling rules, tried in this order.
    return (
        F.when(F.length(k) < 2, k)
        .when(k.rlike("(s|x|z|ch|sh)$"), F.concat(k, F.lit("es")))
        .when(k.rlike("[^aeiou]y$"), F.regexp_replace(k, "y$", "ies"))
        .when(k.rlike("(fe|f)$"), F.regexp_replace(k, "(fe|f)$", "ves"))
        .otherwise(F.concat(k, F.lit("s")))
    )

"""Typed secondary indexes, queried by prefix, range, exact match, predicate, order, offset, limit and count.

An index is a DataFrame: `store_id`, its fields, `key`. Field columns are typed by the index's
specification, so all of a query is plain predicates that reach the Parquet scan. The evaluation order
is fixed whatever the order of arguments: bounds, exact match, predicates, order, offset, limit, count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class InvalidEntry(ValueError):
    """A row does not fit the specification of its index."""


@dataclass(frozen=True)
class IndexSpec:
    """Name and fields of an index; a field type is a DDL string."""

    name: str
    fields: tuple[tuple[str, str], ...]

    @property
    def columns(self) -> list[str]:
        return [f for f, _ in self.fields]


@dataclass
class Registry:
    """Index specifications by name. Rows of unknown names are kept as untyped tuples on reading and skipped on writing."""

    specs: dict[str, IndexSpec] = field(default_factory=dict)

    def register(self, spec: IndexSpec) -> IndexSpec:
        if not isinstance(spec, IndexSpec):
            raise InvalidEntry("an index specification has named, typed fields")
        self.specs[spec.name] = spec
        return spec

    def split_unknown(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """rows with column idx: (known, unknown)."""
        known = F.col("idx").isin(sorted(self.specs)) if self.specs else F.lit(False)
        return rows.where(known), rows.where(~known)


def save(spec: IndexSpec, rows: DataFrame, index: DataFrame | None = None, store_id: str = "main") -> DataFrame:
    """The index with rows (fields, key) added: cast to the field types, a set. A row without a key or with a value that can't be cast is an error."""
    missing = [c for c in [*spec.columns, "key"] if c not in rows.columns]
    if missing:
        raise InvalidEntry(f"{spec.name}: no column {', '.join(missing)}")
    key = F.when(F.col("key").isNull(), F.raise_error(F.lit(f"{spec.name}: entry without a key"))).otherwise(F.col("key"))
    new = rows.select(F.lit(store_id).alias("store_id"), *[F.col(c).cast(t).alias(c) for c, t in spec.fields], key.alias("key"))
    return (index.unionByName(new) if index is not None else new).dropDuplicates()


def delete(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index without rows; rows that aren't there change nothing."""
    on = [c for c in index.columns if c in rows.columns]
    return index.join(rows.select(*on).distinct(), [index[c].eqNullSafe(rows[c]) for c in on], "left_anti")


def lexicographic(columns: Sequence[str], values: Sequence, strict: bool, less: bool) -> Column:
    """columns < values (or >=), compared as tuples; a tuple that is a prefix comes before its extensions.

    With less: columns < values. Otherwise columns >= values. Expanded so that the first column's range reaches the scan.
    """
    out = F.lit(not less and not strict)
    for c, v in reversed(list(zip(columns, values))):
        beyond = F.col(c) < F.lit(v) if less else F.col(c) > F.lit(v)
        out = beyond | ((F.col(c) == F.lit(v)) & out)
    first = F.col(columns[0]) <= F.lit(values[0]) if less else F.col(columns[0]) >= F.lit(values[0])
    return first & out


def select(
    spec: IndexSpec,
    index: DataFrame,
    *,
    store_id: str | None = None,
    match: Sequence | None = None,
    match_key: str | None = None,
    lower: Sequence | None = None,
    upper: Sequence | None = None,
    exact: Sequence | None = None,
    where: Sequence[Column] = (),
    order: str | None = None,
    offset: int = 0,
    limit: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of an index.

    match: equal leading fields. match_key: the entries of one key (with match: of these leading fields).
    lower, upper: tuple bounds, lower inclusive, upper exclusive in either order; inverted bounds give no rows.
    exact: all fields, then the key; at most one row. order: 'asc' or 'desc' over all fields and the key.
    """
    every = [*spec.columns, "key"]
    out = index if store_id is None else index.where(F.col("store_id") == store_id)
    for c, v in zip(spec.columns, match or ()):
        out = out.where(F.col(c) == F.lit(v))
    if match_key is not None:
        out = out.where(F.col("key") == match_key)
    if lower:
        out = out.where(lexicographic(every, lower, strict=False, less=False))
    if upper:
        out = out.where(lexicographic(every, upper, strict=True, less=True))
    if exact is not None:
        if len(exact) != len(every):
            raise InvalidEntry(f"{spec.name}: an exact match takes {len(every)} values")
        for c, v in zip(every, exact):
            out = out.where(F.col(c) == F.lit(v))
        order, limit = "asc", 1
    for predicate in where:
        out = out.where(predicate)
    if order or limit is not None or offset:
        out = out.orderBy(*[F.desc(c) if order == "desc" else F.asc(c) for c in every])
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*(columns or every))


def count(rows: DataFrame) -> DataFrame:
    """The number of rows that survive everything, limit included."""
    return rows.agg(F.count("*").alias("n"))


def inverted(spec: IndexSpec, index: DataFrame) -> DataFrame:
    """The same rows key first: derived, never stored."""
    return index.select("key", *spec.columns)


def unknown_rows(rows: DataFrame) -> DataFrame:
    """Rows of an unregistered index as (idx, tuple of strings)."""
    fields = [c for c in rows.columns if c != "idx"]
    return rows.select("idx", F.array(*[F.col(c).cast(T.StringType()) for c in fields]).alias("tuple"))

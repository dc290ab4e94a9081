"""Identities: canonical text of a row, its SHA-256, keys made of a namespace and a hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL = "\u0000"
NS_BYTES = 8
HEX = 64


def canonical(*columns: Column | str, money: tuple[str, ...] = ()) -> Column:
    """The text that identifies a row: columns joined by '|'. Columns in `money` are doubles of two decimals; null becomes U+0000."""

    def one(c: Column | str) -> Column:
        col = F.col(c) if isinstance(c, str) else c
        if isinstance(c, str) and c in money:
            col = col.cast("decimal(18,2)")
        return F.coalesce(col.cast("string"), F.lit(NULL))

    return F.concat_ws("|", *map(one, columns))


def map_text(column: Column | str) -> Column:
    """Canonical text of a map: its entries in the order of their keys."""
    return F.to_json(F.array_sort(F.map_entries(column)))


def content_hash(*columns: Column | str, money: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the canonical text, as 64 lower-case hexadecimal digits."""
    return F.sha2(canonical(*columns, money=money), 256)


def integer_hash(column: Column | str) -> Column:
    """SHA-256 of a tag byte and the 8 little-endian bytes of an integer: the identity of a bare integer."""
    big = F.lpad(F.hex(F.col(column) if isinstance(column, str) else column), 16, "0")
    little = F.concat(*[F.substring(big, 15 - 2 * i, 2) for i in range(8)])
    return F.sha2(F.unhex(F.concat(F.lit("3C"), little)), 256)


def namespace_ok(ns: Column) -> Column:
    """A namespace is 1 to 8 bytes and not all NUL."""
    return F.octet_length(ns).between(1, NS_BYTES) & (F.regexp_replace(ns, "\u0000", "") != "")


def namespace(text: Column) -> Column:
    """A namespace from text, trailing NULs trimmed; longer ones are an error."""
    trimmed = F.regexp_replace(text, "\u0000+$", "")
    return F.when(F.octet_length(trimmed) <= NS_BYTES, trimmed).otherwise(F.raise_error(F.concat(F.lit("namespace too long: "), text)))


def hash_from_text(text: Column) -> Column:
    """A hash from hexadecimal digits: short ones are padded with zeros on the right, longer ones are an error."""
    return F.when(F.length(text) <= HEX, F.rpad(F.lower(text), HEX, "0")).otherwise(F.raise_error(F.concat(F.lit("hash too long: "), text)))


def hash_ok(digest: Column) -> Column:
    return digest.rlike("^[0-9a-f]{64}$") & (digest != "0" * HEX)


def key_text(ns: Column | str, digest: Column | str) -> Column:
    """ns:hash"""
    return F.concat_ws(":", ns, digest)


def key_of(text: Column) -> Column:
    """struct<ns, hash> of ns:hash; anything but two parts is an error."""
    parts = F.split(text, ":")
    return F.when(F.size(parts) == 2, F.struct(namespace(parts[0]).alias("ns"), hash_from_text(F.try_element_at(parts, F.lit(2))).alias("hash"))).otherwise(F.raise_error(F.concat(F.lit("bad key: "), text)))


def key_bytes(key: Column) -> Column:
    """A binary that sorts as the key does: namespace padded to 8 bytes, then the hash."""
    return F.concat(F.rpad(F.encode(key["ns"], "UTF-8"), F.lit(NS_BYTES), F.lit(b"\x00")), F.unhex(key["hash"]))


def same_path(a: Column, b: Column) -> Column:
    """Key paths are the same if their last keys are; two empty paths are."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.size(a) == F.size(b)).otherwise(F.element_at(a, -1).eqNullSafe(F.element_at(b, -1)))


def set_hash(values: Column) -> Column:
    """Hash of a set of strings, in the order given (sort it first where order shall not matter)."""
    return F.sha2(F.array_join(values, "\n"), 256)

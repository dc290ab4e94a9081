"""Payload codecs as column functions; each has an id, encode and decode. Payloads are binary."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


class CodecNotFound(LookupError):
    """A stored header names a codec that is not registered."""


class Codec:
    """Identity."""

    id = ""

    def encode(self, payload: Column) -> Column:
        return payload

    def decode(self, payload: Column) -> Column:
        return payload


# Without Arrow, rows go to Python a hundred at a time. An Arrow batch would hold ten thousand payloads and their results at once.
@F.udf(BinaryType(), useArrow=False)
def deflate(payload: bytes | None) -> bytes | None:
    return None if payload is None else zlib.compress(payload, 1)


@F.udf(BinaryType(), useArrow=False)
def inflate(payload: bytes | None) -> bytes | None:
    return None if payload is None else zlib.decompress(payload)


class Deflate(Codec):
    """Compressed bytes. (A Parquet table compresses its own columns; this is for payloads that leave it.)"""

    id = "deflate"

    def encode(self, payload: Column) -> Column:
        return deflate(payload)

    def decode(self, payload: Column) -> Column:
        return inflate(payload)


@dataclass
class Hybrid(Codec):
    """A flag byte and the payload, compressed only if that is smaller."""

    inner: Codec

    @property
    def id(self) -> str:
        return f"hybrid({self.inner.id})"

    def encode(self, payload: Column) -> Column:
        packed = self.inner.encode(payload)
        return F.when(F.length(packed) < F.length(payload), F.concat(F.lit(b"\x01"), packed)).otherwise(F.concat(F.lit(b"\x00"), payload))

    def decode(self, payload: Column) -> Column:
        plain = F.substring(payload, F.lit(1), F.lit(1)) == F.lit(b"\x00")
        body = F.substring(payload, F.lit(2), F.length(payload))
        return F.when(plain, body).otherwise(self.inner.decode(F.when(~plain, body)))


@dataclass
class AesGcm(Codec):
    """AES-GCM with a random nonce; the id names the key by its hash."""

    key: bytes

    @property
    def id(self) -> str:
        import hashlib

        return f"aes-gcm-{hashlib.sha256(self.key).hexdigest()[:16]}"

    def encode(self, payload: Column) -> Column:
        return F.aes_encrypt(payload, F.lit(self.key), F.lit("GCM"))

    def decode(self, payload: Column) -> Column:
        return F.aes_decrypt(payload, F.lit(self.key), F.lit("GCM"))


@dataclass
class Segmented(Codec):
    """The payload cut into pieces of `size` bytes, each a hexadecimal field of its inner encoding, joined by commas."""

    inner: Codec
    size: int

    @property
    def id(self) -> str:
        return f"segmented{self.size}({self.inner.id})"

    def encode(self, payload: Column) -> Column:
        def cut(whole: Column) -> Column:
            last = F.greatest(F.lit(0), F.floor((F.length(whole) - 1) / self.size)).cast("int")
            pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.hex(self.inner.encode(F.substring(whole, i * self.size + 1, F.lit(self.size)))))
            return F.encode(F.array_join(pieces, ","), "UTF-8")

        # bound to a variable: the payload may itself be a Python UDF's result, which lambdas can't hold
        return F.transform(F.array(payload), cut)[0]

    def decode(self, payload: Column) -> Column:
        pieces = F.transform(F.split(F.decode(payload, "UTF-8"), ","), lambda h: self.inner.decode(F.unhex(h)))
        return F.aggregate(pieces, F.lit(b""), lambda a, b: F.concat(a, b))


@dataclass
class Stacked(Codec):
    """One codec after another; the id is a|b."""

    first: Codec
    second: Codec

    @property
    def id(self) -> str:
        return f"{self.first.id}|{self.second.id}"

    def encode(self, payload: Column) -> Column:
        return self.second.encode(self.first.encode(payload))

    def decode(self, payload: Column) -> Column:
        return self.first.decode(self.second.decode(payload))


@dataclass
class Onion:
    """Codecs named in the row: encode gives struct<codec_ids, payload>, decode looks the ids up and undoes them from the last."""

    codecs: list[Codec]

    def encode(self, payload: Column) -> Column:
        for codec in self.codecs:
            payload = codec.encode(payload)
        return F.struct(F.array(*[F.lit(c.id) for c in self.codecs]).alias("codec_ids"), payload.alias("payload"))

    @staticmethod
    def decode(row: Column, ids: list[str], registry: dict[str, Codec]) -> Column:
        """Rows whose header is not `ids` are an error; an id that isn't registered is CodecNotFound."""
        missing = [i for i in ids if i not in registry]
        if missing:
            raise CodecNotFound(", ".join(missing))
        payload = F.when(row["codec_ids"] == F.array(*map(F.lit, ids)), row["payload"]).otherwise(F.raise_error(F.concat(F.lit("other codecs: "), F.array_join(row["codec_ids"], "|"))))
        for i in reversed(ids):
            payload = registry[i].decode(payload)
        return payload

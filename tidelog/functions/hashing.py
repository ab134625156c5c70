"""Content hashes as expressions. Products stay inside 64 bits (ANSI mode refuses
overflow): a hash is kept as two halves of 32 bits."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

LOW = 0xFFFFFFFF
#: The offset basis in halves; both multipliers are 435 plus a power of two.
START_HIGH, START_LOW = 0xCBF29CE4, 0x84222325
SHAPE_SHIFT, SAMPLE_SHIFT = 44, 40


def _halves(data: Column, shift: int) -> Column:
    """Struct (hi, lo) of the bytes' xor-multiply hash by 2^shift + 435."""

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("long")
        x = h["lo"].bitwiseXOR(byte)
        t = x * 435
        hi = (h["hi"] * 435 + F.shiftright(t, 32) + F.shiftleft(x, shift - 32)).bitwiseAND(F.lit(LOW))
        return F.struct(hi.alias("hi"), t.bitwiseAND(F.lit(LOW)).alias("lo"))

    start = F.struct(F.lit(START_HIGH).cast("long").alias("hi"), F.lit(START_LOW).cast("long").alias("lo"))
    n = F.octet_length(data)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(at, start, step)


def _joined(h: Column) -> Column:
    return F.shiftleft(h["hi"], 32).bitwiseOR(h["lo"])


def shape_hash(text: Column) -> Column:
    """The id of a template text, as a signed bit pattern. Bytes are walked one by one:
    apply it to distinct texts."""
    return _joined(_halves(F.encode(text, "UTF-8"), SHAPE_SHIFT))


def unsigned(id_: Column) -> Column:
    """The decimal form of a signed bit pattern."""
    wide = id_.cast("decimal(20,0)")
    return F.when(id_ < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def _mod(h: Column, n: int) -> Column:
    return F.pmod(F.pmod(h["hi"], F.lit(n)) * (2**32 % n) + F.pmod(h["lo"], F.lit(n)), F.lit(n))


def selected(event_id: Column, fidelity: int) -> Column:
    """Whether the sample of `fidelity` per cent takes a record, by the low eight bytes
    of its id."""
    if fidelity >= 100:
        return F.lit(True)
    if fidelity <= 0:
        return F.lit(False)
    return _mod(_halves(F.substring(event_id, 9, 8), SAMPLE_SHIFT), 100) < fidelity


def transaction_kept(id_: Column, rate: float) -> Column:
    """Whether a transaction id is in the sample of `rate` (0 to 1), in steps of 1/10000."""
    if rate >= 1:
        return F.lit(True)
    if rate <= 0:
        return F.lit(False)
    return _mod(_halves(F.encode(id_, "UTF-8"), SHAPE_SHIFT), 10_000) < rate * 10_000


def little_endian(n: Column) -> Column:
    """Eight bytes of a 64-bit number, lowest first."""
    return F.unhex(F.concat(*(F.substring(F.lpad(F.hex(n), 16, "0"), 15 - 2 * i, 2) for i in range(8))))


def rollup_id(instance: str, minute_ms: Column, service: Column, template_id: Column, class_: Column) -> Column:
    """16 bytes that name a rollup record, the same on every run."""
    whole = F.concat(
        F.encode(F.lit(instance), "UTF-8"), little_endian(minute_ms), F.encode(F.coalesce(service, F.lit("")), "UTF-8"), little_endian(template_id), F.encode(class_, "UTF-8")
    )
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def shape_hash_of(text: str) -> int:
    """shape_hash for Python code, signed."""
    h = START_HIGH << 32 | START_LOW
    for b in text.encode():
        h = (h ^ b) * ((1 << SHAPE_SHIFT) + 435) & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


def with_shape_hash(df: DataFrame, text: str, name: str = "template_id") -> DataFrame:
    """Adds the hash of a text column to every row. Batches hash each distinct text once;
    no join or shuffle is needed, and the optimizer can't repeat the work."""
    ship(df.sparkSession)
    return df.withColumn(name, F.pandas_udf(_hash_batch, "long")(text))


@lru_cache(maxsize=65_536)
def _cached(text: str) -> int:
    return shape_hash_of(text)


def _hash_batch(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _cached(t) for t in texts], dtype="Int64")

"""Places in an order of arrival, stored with their types and without loss."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def _text(value: Column, kind: T.DataType) -> Column:
    """A value as text that gives the same value back."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    return value.cast("string")


def _literal(text: str | None, kind: T.DataType) -> Column | None:
    if text is None:
        return None
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(int(text)))
    if isinstance(kind, T.BinaryType):
        return F.unhex(F.lit(text))
    return F.lit(text).cast(kind)


def encode_place(place: Column, kinds: T.StructType) -> Column:
    """A struct of order values as JSON text with the types of the values.

    Instants are stored as microseconds and bytes as hex digits; numbers, decimals, days,
    zone-free times and text have a text form that is exact. Null stays null. An order by
    nested values is refused.
    """
    nested = [field.name for field in kinds if isinstance(field.dataType, _NESTED)]
    if nested:
        raise ValueError("an order needs plain values, no arrays, maps or structs")
    values = [_text(place[field.name], field.dataType) for field in kinds]
    types = [F.lit(field.dataType.simpleString()) for field in kinds]
    encoded = F.to_json(
        F.struct(F.array(*types).alias("types"), F.array(*values).alias("values"))
    )
    return F.when(place.isNotNull(), encoded)


def decode_place(stored: str, kinds: T.StructType) -> list[Column | None]:
    """The stored values as literals that a scan's filters can use; null is ``None``.

    A stored place of other types cannot be compared and is an error. Places that were
    stored as one JSON object of plain values are read by the types of the order.
    """
    found = json.loads(stored)
    if "types" not in found:
        values = list(found.values())
        return [
            None if value is None else F.lit(str(value)).cast(field.dataType)
            for value, field in zip(values, kinds)
        ]
    wanted = [field.dataType.simpleString() for field in kinds]
    if found["types"] != wanted:
        raise ValueError(f"the order was stored as {found['types']} and is now {wanted}")
    return [_literal(text, field.dataType) for text, field in zip(found["values"], kinds)]


def after(keys: Sequence[Column], last: Sequence) -> Column:
    """Whether a row's place comes after the last one. Null comes before every value."""
    condition, same = F.lit(False), F.lit(True)
    for key, value in zip(keys, last):
        later = key.isNotNull() if value is None else key > F.lit(value)
        equal = key.isNull() if value is None else key == F.lit(value)
        condition = condition | (same & later)
        same = same & equal
    return condition

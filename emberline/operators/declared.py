"""Rows stored as a declared table: columns by name, values as their declared types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .merge import quoted


class WrongColumns(TypeError):
    """Columns that a declared table has and the rows lack, or whose type can't be stored."""


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBERS = (*_INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def storable(kind: T.DataType, declared: T.DataType) -> bool:
    """Whether values of a kind may be stored as a declared one, by the rules of SQL's
    assignment: alike, numbers as numbers, dates and times as one another, flat values as
    text, and the parts of nested ones; text as nothing else, nulls as anything."""
    if kind == declared or isinstance(kind, T.NullType):
        return True
    if isinstance(kind, T.ArrayType) and isinstance(declared, T.ArrayType):
        return storable(kind.elementType, declared.elementType)
    if isinstance(kind, T.MapType) and isinstance(declared, T.MapType):
        return storable(kind.keyType, declared.keyType) and storable(kind.valueType, declared.valueType)
    if isinstance(kind, T.StructType) and isinstance(declared, T.StructType):
        return len(kind) == len(declared) and all(storable(a.dataType, b.dataType) for a, b in zip(kind, declared, strict=True))
    flat = lambda t: not isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
    if isinstance(declared, T.StringType):
        return flat(kind)
    return any(isinstance(kind, g) and isinstance(declared, g) for g in (_NUMBERS, _TIMES))


def as_declared(df: DataFrame, schema: str | T.StructType, named: dict[str, str] | None = None) -> DataFrame:
    """The rows with the declared columns, in their order and types; named: df's name of a
    declared column where it differs. Other columns of df are left out. A declared column
    that df lacks or whose type can't be stored (see storable) raises WrongColumns; a value
    that its declared type can't hold fails when the rows are stored."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    own = {f.name.lower(): f for f in df.schema}
    out, wrong = [], []
    for f in wanted:
        source = own.get((named or {}).get(f.name, f.name).lower())
        if source is None:
            wrong.append(f"{f.name} is missing")
        elif not storable(source.dataType, f.dataType):
            wrong.append(f"{f.name} is {source.dataType.simpleString()}, not {f.dataType.simpleString()}")
        else:
            out.append(F.col(quoted(source.name)).cast(f.dataType).alias(f.name))
    if wrong:
        raise WrongColumns("; ".join(wrong))
    return df.select(*out)

"""Free-form JSON columns: parsed once as VARIANT, their paths found in the data and read as typed columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyq.functions.text import ColumnOrName


@dataclass(frozen=True)
class Path:
    """A path of objects, and the type of what stands at its end in all rows; string where rows differ."""

    keys: tuple[str, ...]
    kind: str

    @property
    def name(self) -> str:
        return "_".join(self.keys)

    @property
    def json_path(self) -> str:
        """Spark's path of the keys; a key is quoted by the mark that it doesn't hold."""
        quoted = ("\"" if "'" in k else "'" for k in self.keys)
        return "$" + "".join(f"[{q}{k}{q}]" for q, k in zip(quoted, self.keys))


def parsed(column: ColumnOrName) -> Column:
    """JSON text as a variant; broken and null texts are null."""
    return F.try_parse_json(column)


def _ends(kind: T.DataType, keys: tuple[str, ...] = ()) -> list[Path]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _ends(f.dataType, (*keys, f.name))]
    return [Path(keys, _readable(kind))] if keys else []


def _readable(kind: T.DataType) -> str:
    """The type to read a value as: variants as text, fields of objects inside arrays kept."""
    if isinstance(kind, (T.VariantType, T.NullType)):
        return "string"
    if isinstance(kind, T.ArrayType):
        return f"array<{_readable(kind.elementType)}>"
    if isinstance(kind, T.StructType):
        return "struct<" + ",".join(f"`{f.name}`:{_readable(f.dataType)}" for f in kind.fields) + ">"
    return kind.simpleString()


def paths(df: DataFrame, column: str) -> list[Path]:
    """The paths of a JSON column over all rows, by one aggregate; none where no row is an object.

    The aggregate holds each path once, so keys should be names and not ids. Keys that hold
    both quotation marks can't be asked for and are left out.
    """
    found = df.agg(F.schema_of_variant_agg(parsed(column)).alias("s")).head().s
    ends = _ends(T.DataType.fromDDL(found.replace("OBJECT<", "STRUCT<"))) if found and found.startswith("OBJECT<") else []
    return [p for p in ends if not any("'" in k and '"' in k for k in p.keys)]


def shredded(df: DataFrame, column: str, wanted: list[Path] | None = None, prefix: str = "") -> DataFrame:
    """df with a typed column for each path (all that are found, by default), named by its keys; what isn't there or isn't of the type is null.

    The text is parsed once for each row. A column of the same name is replaced.
    """
    wanted = paths(df, column) if wanted is None else wanted
    held = "parsed"
    while held in df.columns or any(held == prefix + p.name for p in wanted):
        held += "_"
    typed = df.withColumn(held, parsed(column))
    return typed.withColumns({prefix + p.name: F.try_variant_get(held, p.json_path, p.kind) for p in wanted}).drop(held)

"""Schema text (one ``name,type`` per line) to and from StructType."""

from __future__ import annotations

from pyspark.sql import types as T

#: Type names of the schema text; fixed values.
TYPES: dict[str, T.DataType] = {
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "string": T.StringType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(),
}
_NAMES = {type(v): k for k, v in TYPES.items()}


def parse_schema(text: str) -> T.StructType:
    """Blank lines, CR line ends, spaces round the type and a trailing comma are accepted; anything else raises."""
    fields = []
    for number, line in enumerate(text.replace("\r", "").split("\n"), 1):
        if not line.strip():
            continue
        name, comma, kind = line.partition(",")
        kind = kind.strip(" ,")
        if not comma or not name or kind not in TYPES:
            raise ValueError(f"schema line {number}: {line!r}")
        fields.append(T.StructField(name, TYPES[kind], True))
    return T.StructType(fields)


def format_schema(schema: T.StructType) -> str:
    out = []
    for f in schema.fields:
        if type(f.dataType) not in _NAMES:
            raise ValueError(f"{f.name}: {f.dataType.simpleString()} has no name in schema text")
        out.append(f"{f.name},{_NAMES[type(f.dataType)]}\n")
    return "".join(out)


def load_schema(path: str) -> T.StructType:
    with open(path, encoding="utf-8") as f:
        return parse_schema(f.read())


def save_schema(schema: T.StructType, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(format_schema(schema))

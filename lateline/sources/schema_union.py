"""One schema over files of different schemas: columns by name, types widened where nothing is lost.

The rule for a column whose types differ: whole numbers widen to the longer one, whole numbers of
up to 32 bits and floats widen to double, decimals to one that holds both, a date to a
timestamp without zone; structs are united field by field, arrays by their elements,
maps by their values. Everything else is a conflict and an error. Spark's Parquet
reader widens while it decodes, so the union is read in one scan.
"""

import hashlib
import json

from pyspark.sql import types as T

LOG = "_schemas"  # beside the data; readers skip names with an underscore
_WHOLE = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


class SchemaConflict(ValueError):
    """Two files hold a column in types that no common type holds."""


def widened(one, other, name="row"):
    """The type that holds all values of both types."""
    if one == other or isinstance(other, T.NullType):
        return one
    if isinstance(one, T.NullType):
        return other
    if isinstance(one, T.StructType) and isinstance(other, T.StructType):
        return union_of([one, other], name)
    if isinstance(one, T.ArrayType) and isinstance(other, T.ArrayType):
        return T.ArrayType(widened(one.elementType, other.elementType, f"{name}.element"))
    if isinstance(one, T.MapType) and isinstance(other, T.MapType) and one.keyType == other.keyType:
        return T.MapType(one.keyType, widened(one.valueType, other.valueType, f"{name}.value"))
    kinds = {type(one), type(other)}
    if kinds <= set(_WHOLE):
        return max(one, other, key=lambda kind: _WHOLE.index(type(kind)))
    if kinds <= {*_WHOLE[:3], T.FloatType, T.DoubleType} and not kinds <= {*_WHOLE[:3], T.FloatType}:
        return T.DoubleType()
    if kinds == {T.DecimalType}:
        scale = max(one.scale, other.scale)
        whole = max(one.precision - one.scale, other.precision - other.scale)
        if scale + whole <= 38:
            return T.DecimalType(scale + whole, scale)
    if kinds == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    raise SchemaConflict(f"column {name}: {one.simpleString()} and {other.simpleString()} have no common type")


def union_of(schemas, name=""):
    """The union of struct types; names that differ in case alone are a conflict, for Spark takes them as one."""
    found, spelled = {}, {}
    for schema in schemas:
        for field in schema.fields:
            path = f"{name}.{field.name}".lstrip(".")
            known = spelled.setdefault(field.name.lower(), field.name)
            if known != field.name:
                raise SchemaConflict(f"columns {known} and {path} differ in case alone")
            kind = found.get(field.name)
            found[field.name] = field.dataType if kind is None else widened(kind, field.dataType, path)
    return T.StructType([T.StructField(column, kind, True) for column, kind in found.items()])


def record(filesystem, path_of, table, schema):
    """Note the schema of a write beside its table; equal schemas are one note, so writers never clash."""
    text = json.dumps(schema.jsonValue(), sort_keys=True)
    place = path_of(f"{table}/{LOG}/{hashlib.sha256(text.encode()).hexdigest()}.json")
    if filesystem.exists(place):
        return
    out = filesystem.create(place, True)
    try:
        out.writeBytes(text)  # JSON in ASCII
    finally:
        out.close()


def recorded(spark, table):
    """The schemas noted beside a table, in a fixed order: as many as different ones were written."""
    notes = spark.read.text(f"{table}/{LOG}/*.json", wholetext=True).collect()
    return [T.StructType.fromJson(json.loads(text)) for text in sorted(row["value"] for row in notes)]

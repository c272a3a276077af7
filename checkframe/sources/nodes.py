"""What a schema looks at: a value of JSON text, or a typed value of a row, behind one interface.

A node tells its token kind (``string bool int uint float vec map``, ``option`` where nothing
is there), whether it has a schema type, its members, its items, and its value as a rule
sees it.  JSON nodes are VARIANT columns and decide all that row by row.  Row nodes are bound to
Spark's types: most answers are settled while the plan is built, and no text is made of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, UnknownField
from ..plans.kinds import Value

READ = {"string": "string", "boolean": "boolean", "int": "bigint", "uint": "decimal(20,0)", "float": "double"}
SPARK = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.LongType(), "uint": T.DecimalType(20, 0), "float": T.DoubleType()}
KIND = {"string": "string", "boolean": "bool", "int": "int", "uint": "uint", "float": "float", "array": "vec", "object": "map"}
I64 = (-(2**63), 2**63 - 1)
U64 = 2**64 - 1


def _wide(number: int) -> Column:
    return F.lit(str(number)).cast("decimal(38,0)")


@dataclass
class JsonNode:
    """A JSON value."""

    v: Column

    def tokens(self) -> tuple[str, ...]:
        return tuple(KIND.values())

    def there(self) -> Column:
        return self.v.isNotNull() & ~F.is_variant_null(self.v)

    def kind(self) -> Column:
        t = F.schema_of_variant(self.v)
        number = F.try_variant_get(self.v, "$", "decimal(38,0)")
        big = t.rlike(r"^DECIMAL\((19|20),0\)") & (number <= _wide(U64)) & (number >= 0)
        return (
            F.when(~self.there(), "option")
            .when(t == "STRING", "string")
            .when(t == "BOOLEAN", "bool")
            .when(t == "BIGINT", "int")
            .when(big, "uint")
            .when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float")
            .when(t.startswith("ARRAY"), "vec")
            .otherwise("map")
        )

    def fits(self, kind: str) -> Column:
        """Whether it has a schema type; numbers go by their token."""
        t = F.schema_of_variant(self.v)
        if kind in ("string", "boolean"):
            return t == kind.upper()
        if kind == "int":
            return t == "BIGINT"
        if kind == "uint":
            return ((t == "BIGINT") & (F.try_variant_get(self.v, "$", "bigint") >= 0)) | (self.kind() == "uint")
        if kind == "float":
            return self.kind() == "float"
        return t.startswith("ARRAY" if kind == "array" else "OBJECT")

    def _get(self, name: str, kind: str = "variant") -> Column:
        quoted = name.replace("\\", "\\\\").replace('"', '\\"')
        return F.try_variant_get(self.v, f'$["{quoted}"]', kind)

    def child(self, name: str) -> JsonNode:
        return JsonNode(self._get(name))

    def each(self, item: Callable[[JsonNode, Column], Column]) -> Column:
        return F.transform(F.try_variant_get(self.v, "$", "array<variant>"), lambda x, i: item(JsonNode(x), i))

    def value(self, name: str, kind: str, optional_fields: dict, declared: str = "", siblings=None) -> Value:
        """The member ``name`` as rules of a schema type see it."""
        if kind == "object":
            return Value(self._get(name, "map<string,variant>"), T.MapType(T.StringType(), T.VariantType()), siblings=siblings)
        if kind == "array":
            items = self._get(name, "array<variant>")
            if optional_fields:
                dtype = JsonNode(F.col("_")).keys(optional_fields)[1]
                return Value(F.transform(items, lambda x: JsonNode(x).keys(optional_fields)[0]), T.ArrayType(dtype), siblings=siblings)
            return Value(F.transform(items, lambda x: JsonNode(x).key()), T.ArrayType(T.StringType()), siblings=siblings)
        return Value(self._get(name, READ[kind]), SPARK[kind], KIND[kind], siblings=siblings)

    def key(self) -> Column:
        """The value as a text that only equal values share; null where nothing is there.

        Numbers are read as numbers, so that 1.0 and 1.00, or 10.0 and 1e1, are one; a text of digits is no number.
        """
        number = F.try_variant_get(self.v, "$", "double")
        of_kind = self.kind()
        plain = F.when(of_kind == "float", F.concat(F.lit("f"), (number + F.lit(0.0)).cast("string"))).otherwise(F.to_json(self.v))
        return F.when(self.there(), F.concat_ws(":", of_kind, plain))

    def keys(self, fields: dict) -> tuple[Column, T.StructType]:
        """Keys of an object's declared fields, for compound keys; a value of another type has none."""
        columns, dtype = [], T.StructType()
        for name, spec in fields.items():
            below = self.child(name)
            column, kind = below.keys(spec.fields) if spec.type == "object" and spec.fields else (below.key(), T.StringType())
            columns.append(column.alias(name))
            dtype = dtype.add(name, kind)
        return F.when(F.coalesce(self.fits("object"), F.lit(False)), F.struct(*columns)), dtype


@dataclass
class Naming:
    """How fields of rows are named in the object they make: new names by path, and structs whose fields join their parent's."""

    rename: dict[str, str] = field(default_factory=dict)
    flatten: frozenset[str] = frozenset()

    @classmethod
    def of(cls, dtype: T.StructType, rename: dict[str, str], flatten: Iterable[str]) -> Naming:
        """Every path has to name a field; only structs can be flattened."""
        found: dict[str, T.DataType] = {}

        def walk(dtype: T.DataType, path: str) -> None:
            if isinstance(dtype, T.ArrayType):
                walk(dtype.elementType, path)
            elif isinstance(dtype, T.StructType):
                for f in dtype.fields:
                    here = f"{path}.{f.name}" if path else f.name
                    found[here] = f.dataType
                    walk(f.dataType, here)

        walk(dtype, "")
        flatten = frozenset(flatten)
        for path in (*rename, *flatten):
            if path not in found:
                raise UnknownField(path)
        for path in flatten:
            if not isinstance(found[path], T.StructType):
                raise ConfigError(f"{path}: only structs can be flattened")
        return cls(dict(rename), flatten)


def _plain(dtype: T.DataType) -> bool:
    return not isinstance(dtype, T.ArrayType | T.MapType | T.StructType | T.BinaryType | T.VariantType | T.NullType)


@dataclass
class RowNode:
    """A typed value; ``members`` is given for the row itself."""

    column: Column
    dtype: T.DataType
    naming: Naming = field(default_factory=Naming)
    path: str = ""
    given: dict[str, Column] | None = None

    @staticmethod
    def make(column: Column, dtype: T.DataType, naming: Naming, path: str) -> RowNode | JsonNode:
        if isinstance(dtype, T.VariantType):
            return JsonNode(column)
        if isinstance(dtype, T.UserDefinedType):
            dtype = dtype.sqlType()
        return RowNode(column, dtype, naming, path)

    def _floating(self) -> bool:
        return isinstance(self.dtype, T.FloatType | T.DoubleType)

    def _wide_integer(self) -> bool:
        return isinstance(self.dtype, T.DecimalType) and self.dtype.scale == 0 and self.dtype.precision > 18

    def tokens(self) -> tuple[str, ...]:
        t = self.dtype
        if self._wide_integer():
            return ("int", "uint", "float")
        if isinstance(t, T.BooleanType):
            return ("bool",)
        if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType) or isinstance(t, T.DecimalType) and t.scale == 0:
            return ("int",)
        if isinstance(t, T.FloatType | T.DoubleType | T.DecimalType):
            return ("float",)
        if isinstance(t, T.ArrayType | T.BinaryType):
            return ("vec",)
        if isinstance(t, T.StructType | T.MapType):
            return ("map",)
        return () if isinstance(t, T.NullType) else ("string",)

    def there(self) -> Column:
        """NaN and the infinities have no JSON number: they count as nothing."""
        c = self.column
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) if self._floating() else c.isNotNull()

    def _in(self, low: int, high: int) -> Column:
        wide = self.column.cast("decimal(38,0)")
        return (wide >= _wide(low)) & (wide <= _wide(high))

    def kind(self) -> Column:
        if self._wide_integer():
            token = F.when(self._in(*I64), "int").when(self._in(0, U64), "uint").otherwise("float")
        else:
            token = F.lit((*self.tokens(), "option")[0])
        return F.when(self.there(), token).otherwise("option")

    def fits(self, kind: str) -> Column:
        if kind in ("int", "uint", "float") and self._wide_integer():
            inside = self._in(*I64) if kind == "int" else self._in(0, U64)
            return inside if kind != "float" else ~self._in(*I64) & ~self._in(0, U64)
        if kind == "uint" and self.tokens() == ("int",):
            return self.column >= 0
        return F.lit(self.tokens() == (KIND[kind],))

    def members(self) -> dict[str, RowNode | JsonNode]:
        """By the names they have in the object; of equal names the last counts."""
        out: dict[str, RowNode | JsonNode] = {}
        if isinstance(self.dtype, T.StructType):
            for f in self.dtype.fields:
                path = f"{self.path}.{f.name}" if self.path else f.name
                node = RowNode.make(self.column.getField(f.name) if self.given is None else self.given[f.name], f.dataType, self.naming, path)
                if path in self.naming.flatten:
                    out |= node.members()
                else:
                    out[self.naming.rename.get(path, f.name)] = node
        return out

    def child(self, name: str) -> RowNode | JsonNode:
        if isinstance(self.dtype, T.MapType) and _plain(self.dtype.keyType):
            found = F.try_element_at(self.column, F.lit(name).try_cast(self.dtype.keyType))
            return RowNode.make(found, self.dtype.valueType, self.naming, self.path)
        return self.members().get(name, RowNode(F.lit(None), T.NullType()))

    def _items(self) -> tuple[Column, T.DataType]:
        """The items of an array; of bytes, their numbers."""
        if isinstance(self.dtype, T.ArrayType):
            return self.column, self.dtype.elementType
        n = F.octet_length(self.column)
        each = F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.hex(F.substring(self.column, i, F.lit(1))), 16, 10).cast("int"))
        return F.when(n > 0, each).when(n == 0, F.array().cast("array<int>")), T.IntegerType()

    def each(self, item: Callable[[RowNode | JsonNode, Column], Column]) -> Column | None:
        if self.tokens() != ("vec",):
            return None
        items, of = self._items()
        return F.transform(items, lambda x, i: item(RowNode.make(x, of, self.naming, self.path), i))

    def text(self) -> Column:
        """A plain value as its JSON text would say it."""
        if isinstance(self.dtype, T.TimestampType):
            return F.date_format(self.column, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
        if isinstance(self.dtype, T.TimestampNTZType):
            return F.date_format(self.column, "yyyy-MM-dd'T'HH:mm:ss.SSS")
        return self.column.cast("string")

    def value(self, name: str, kind: str, optional_fields: dict, declared: str = "", siblings=None) -> Value:
        node = self.child(name)
        if isinstance(node, JsonNode):
            return JsonNode(F.to_variant_object(F.map_from_arrays(F.array(F.lit(name)), F.array(node.v)))).value(name, kind, optional_fields, declared, siblings)
        return node.own(kind, optional_fields, siblings)

    def own(self, kind: str, fields: dict, siblings=None) -> Value:
        """This value as rules of a schema type see it; null where the type cannot hold it."""
        if kind == "object":
            if isinstance(self.dtype, T.MapType):
                return Value(self.column, self.dtype, siblings=siblings)
            names = F.array(*[F.lit(n) for n in self.members()]).cast("array<string>")
            shown = F.map_from_arrays(names, names)
            return Value(F.when(self.column.isNotNull(), shown) if self.tokens() == ("map",) else F.lit(None).cast("map<string,string>"), T.MapType(T.StringType(), T.StringType()), siblings=siblings)
        if kind == "array":
            if self.tokens() != ("vec",):
                return Value(F.lit(None).cast("array<string>"), T.ArrayType(T.StringType()), siblings=siblings)
            items, of = self._items()
            if fields:
                dtype = RowNode.make(F.col("_"), of, self.naming, self.path).keys(fields)[1]
                return Value(F.transform(items, lambda x: RowNode.make(x, of, self.naming, self.path).keys(fields)[0]), T.ArrayType(dtype), siblings=siblings)
            return Value(F.transform(items, lambda x: RowNode.make(x, of, self.naming, self.path).key()), T.ArrayType(RowNode.make(F.col("_"), of, self.naming, self.path).key_type()), siblings=siblings)
        if not _plain(self.dtype):
            return Value(F.lit(None).cast(READ[kind]), SPARK[kind], KIND[kind], siblings=siblings)
        column = F.when(self.there(), self.text() if kind == "string" else self.column.try_cast(READ[kind]))
        return Value(column, SPARK[kind], KIND[kind], siblings=siblings)

    def key_type(self) -> T.DataType:
        return T.StringType() if isinstance(self.dtype, T.NullType) else self.dtype

    def key(self) -> Column:
        """What equal values share: the value itself; null where nothing is there."""
        return F.when(self.there(), self.column)

    def keys(self, fields: dict) -> tuple[Column, T.StructType]:
        columns, dtype = [], T.StructType()
        for name, spec in fields.items():
            below = self.child(name)
            if spec.type == "object" and spec.fields:
                column, kind = below.keys(spec.fields)
            else:
                column, kind = below.key(), T.StringType() if isinstance(below, JsonNode) else below.key_type()
            columns.append(column.cast(kind).alias(name))
            dtype = dtype.add(name, kind)
        return (F.when(self.there(), F.struct(*columns)) if self.tokens() == ("map",) else F.lit(None).cast(dtype)), dtype

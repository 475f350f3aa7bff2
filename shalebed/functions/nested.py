"""Nested values: lists of named and typed pairs, their builders, matches and texts.

A list of pairs is an array of struct(name, type, value); value is text. Types are int, string, boolean and double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

PAIR = "struct<name:string,type:string,value:string>"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pair(name: str, type_: str, value: Column | str) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(type_).alias("type"), _c(value).cast("string").alias("value"))


def empty() -> Column:
    return F.array().cast(f"array<{PAIR}>")


def add(pairs: Column, new: Column, unique: str | None = "name") -> Column:
    """With a pair at the end; those of its name go (unique="name"), or of its name and type ("type"), or none (None)."""
    same = {"name": lambda p: p["name"] == new["name"], "type": lambda p: (p["name"] == new["name"]) & (p["type"] == new["type"]), None: lambda p: F.lit(False)}[unique]
    return F.array_append(F.filter(pairs, lambda p: ~same(p)), new)


def remove(pairs: Column, name: str, type_: str | None = None) -> Column:
    """Without the pairs of a name, or of a name and type."""
    return F.filter(pairs, lambda p: ~((p["name"] == name) & (F.lit(type_ is None) | (p["type"] == F.lit(type_)))))


def lookup(pairs: Column, name: str) -> Column:
    """The value of the last pair of a name, null if there is none."""
    return F.get(F.filter(F.reverse(pairs), lambda p: p["name"] == name), 0)["value"]


def merge(left: Column, right: Column) -> Column:
    """All pairs, those of right instead of left's of the same name."""
    return F.concat(F.filter(left, lambda p: ~F.exists(right, lambda q: q["name"] == p["name"])), right)


def match(p: Column, literal: str, pattern: bool = False) -> Column:
    """1 if a pair's value is what a literal writes, 0 if not, -1 if the literal is none of its type. A pattern must match a whole string value."""
    value, type_ = p["value"], p["type"]
    as_int = F.lit(literal).try_cast("long") if not literal.lower().startswith("0x") else F.conv(F.lit(literal[2:]), 16, 10).try_cast("long")
    as_boolean = {"true": True, "1": True, "false": False, "0": False}.get(literal.lower())
    as_double = F.lit(literal).try_cast("double")
    verdict = lambda known, same: F.when(~known, -1).when(same, 1).otherwise(0)
    if pattern:
        return F.when(type_ != "string", -1).when(value.rlike(f"^(?:{literal})\\z"), 1).otherwise(0)
    return (
        F.when(type_ == "int", verdict(as_int.isNotNull(), value.try_cast("long") == as_int))
        .when(type_ == "double", verdict(as_double.isNotNull(), value.try_cast("double") == as_double))
        .when(type_ == "boolean", verdict(F.lit(as_boolean is not None), value.try_cast("boolean") == F.lit(as_boolean)))
        .otherwise(verdict(F.lit(True), value == literal))
    )


#: Characters with escapes of their own in JSON texts.
ESCAPES = {'"': '\\"', "\n": "\\n", "\r": "\\r", "\\": "\\\\", "\f": "\\f", "\t": "\\t", "\b": "\\b"}


def json_string(x: Column | str) -> Column:
    """A text as a JSON string of 7-bit ASCII: other characters of the first plane as \\uXXXX, those beyond it left out."""
    c = _c(x)

    def one(ch: Column) -> Column:
        code = F.ascii(ch)
        out = F.when((code < 32) | ((code > 127) & (code <= 0xFFFF)), F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))).when(code > 0xFFFF, "").otherwise(ch)
        for k, v in ESCAPES.items():
            out = F.when(ch == F.lit(k), F.lit(v)).otherwise(out)
        return F.when(ch == "", "").otherwise(out)

    plain = c.rlike(r'^[ !#-\[\]-~]*\z')
    return F.concat(F.lit('"'), F.when(plain, c).otherwise(F.array_join(F.transform(F.split(c, ""), one), "")), F.lit('"'))


def json_text(value: Column, type_: DataType) -> Column:
    """A nested value of a type as JSON without blanks; null members are null."""
    if isinstance(type_, StructType):
        members = [F.concat(json_string(F.lit(f.name)), F.lit(":"), json_text(value[f.name], f.dataType)) for f in type_.fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    elif isinstance(type_, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_text(x, type_.elementType)), ","), F.lit("]"))
    elif isinstance(type_, StringType):
        out = json_string(value)
    else:
        out = value.cast("string")
    return F.when(value.isNull(), F.lit("null")).otherwise(out)


Printer = Callable[[Column], Column]


def _shown(value: Column, type_: DataType, printers: dict[str, Printer]) -> Column:
    own = printers.get(type_.simpleString())
    text = own(value) if own else F.concat(F.lit("'"), value, F.lit("'")) if isinstance(type_, StringType) else value.cast("string")
    return F.coalesce(text, F.lit("null"))


def _member(value: Column, name: str, type_: DataType, printers: dict[str, Printer], indent: int) -> Column:
    pad = " " * indent
    own = type_.simpleString() in printers
    if isinstance(type_, StructType) and not own:
        return F.concat(F.array(F.lit(f"{pad}{name}:")), lines(value, type_, printers, indent + 4))
    if isinstance(type_, ArrayType) and not own:
        item = type_.elementType
        place = lambda i: F.concat(F.lit(f"{pad}{name}["), i.cast("string"), F.lit("]:"))
        if isinstance(item, StructType):
            return F.flatten(F.transform(value, lambda x, i: F.concat(F.array(place(i)), lines(x, item, printers, indent + 4))))
        return F.transform(value, lambda x, i: F.concat(place(i), F.lit(" "), _shown(x, item, printers)))
    return F.array(F.concat(F.lit(f"{pad}{name}: "), _shown(value, type_, printers)))


def lines(value: Column, type_: StructType, printers: dict[str, Printer] | None = None, indent: int = 0) -> Column:
    """A nested value as an array of lines: `name: value`, strings quoted, members of a struct four blanks further in, items of an array as name[i].

    printers by type name (such as bigint) replace how values are written.
    """
    parts = []
    for f in type_.fields:
        parts.append(_member(value[f.name], f.name, f.dataType, printers or {}, indent))
    return F.concat(*parts)

"""The order over values of all kinds, as keys whose bytes sort as the values do.

A key is text: two hex digits for the kind's class, then what tells values of
the class apart.  Lists open each element with ``!`` and end with a space, which
sort below all else, so a shorter list comes before what it begins.  Numbers of
all kinds share a class and are compared by their exact decimal values, which,
unlike comparing floats with integers cast to floats, is transitive; a float has
the value of its shortest decimal form.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import values as V
from .values import TYPE_RANK, col

NUMBER_CLASS = TYPE_RANK["SignedInt"]
DEPTH = 3  # levels of lists and records told apart by their elements; below that by their text
MOST = 9999  # decimal exponents lie within it


def collation_key(s, collation: str = "UNICODE") -> Column:
    """Bytes that compare as the texts do under a collation.

    The optimiser's own expression for joins on collated text; SQL has no name for it.
    """
    from pyspark.sql.classic.column import Column as Classic

    collated = F.collate(col(s), collation)
    if not isinstance(collated, Classic):
        raise NotImplementedError("collation keys need a classic session")
    from pyspark import SparkContext

    jvm = SparkContext._active_spark_context._jvm
    bridge = jvm.org.apache.spark.sql.classic.ExpressionUtils
    return Classic(bridge.column(jvm.org.apache.spark.sql.catalyst.expressions.CollationKey(bridge.expression(collated._jc))))


def number_key(text) -> Column:
    """Key of a number in decimal text, with or without fraction and exponent; also NaN, Infinity and -0.0."""

    def of(t):
        body = F.regexp_replace(t, "^[-+]", "")
        mantissa = F.regexp_extract(t, "^[-+]?([0-9.]+)", 1)
        return V.let(F.struct(
            t.startswith("-").alias("negative"), body.alias("body"), mantissa.alias("mantissa"), F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "^0+", "").alias("digits"),
            F.length(F.split_part(mantissa, F.lit("."), F.lit(2))).alias("part"), F.coalesce(F.regexp_extract(t, "[eE]([-+]?[0-9]+)$", 1).try_cast("int"), F.lit(0)).alias("power"),
        ), placed)

    def placed(x):
        exponent = F.length(x["digits"]) - x["part"] + x["power"]
        shown = lambda e: F.lpad((e + MOST).cast("string"), 5, "0")
        digits = F.regexp_replace(x["digits"], "0+$", "")
        return (
            F.when(x["body"] == "NaN", "3").when(x["body"] == "Infinity", F.when(x["negative"], "000000").otherwise("299999"))
            .when(x["digits"] == "", F.when(x["negative"] & F.contains(x["mantissa"], F.lit(".")), "0~").otherwise("1"))
            .when(x["negative"], F.concat(F.lit("0"), shown(-exponent), F.translate(digits, "0123456789", "9876543210"), F.lit("~")))
            .otherwise(F.concat(F.lit("2"), shown(exponent), digits))
        )

    return V.let(col(text), of)


def class_of(kind: str) -> str:
    return f"{NUMBER_CLASS if kind in ('SignedInt', 'UnsignedInt', 'Float') else TYPE_RANK[kind]:02X}"


def key_text(v, depth: int = DEPTH) -> Column:
    """Key of a VARIANT as text."""
    v = col(v)

    def after(kind, *parts):
        return F.concat(F.lit(class_of(kind)), *parts)

    def of(x):
        k, text = x["k"], x["t"]
        if depth > 0:
            items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda y: F.concat(F.lit("!"), key_text(y, depth - 1)))
            named = F.transform(
                F.array_sort(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)),
                lambda e: F.concat(F.lit("!"), F.hex(e["key"]), F.lit("#"), key_text(e["value"], depth - 1)),
            )
            vec, obj = (F.concat(F.array_join(y, ""), F.lit(" ")) for y in (items, named))
        else:
            vec = obj = F.concat(F.hex(text), F.lit(" "))
        return (
            F.when(k.isNull(), "FF").when(k == "Unit", class_of("Unit")).when(k == "Bool", after("Bool", F.when(text == "true", "1").otherwise("0")))
            .when(k.isin("SignedInt", "UnsignedInt", "Float"), after("SignedInt", number_key(text)))
            .when(k == "String", after("String", F.hex(collation_key(text)))).when(k == "Vec", after("Vec", vec)).when(k == "Object", after("Object", obj))
            .otherwise(after("Unknown", F.hex(text)))
        )

    return V.let(F.struct(V.kind(v).alias("k"), v.cast("string").alias("t")), of)


def sort_key(v, depth: int = DEPTH) -> Column:
    """BINARY key of a VARIANT in the order over all kinds; null stands for a malformed value and comes last.

    Unit, then false and true, numbers by value, lists element by element, records
    field by field (name, then value), texts by root collation.  Equal keys are
    equal values: 1 and 1.0, or texts that the collation does not tell apart.
    """
    return F.encode(key_text(v, depth), "US-ASCII")


def byte_order_key(b) -> Column:
    """BINARY key of an encoded value in byte order: its type id as it is stored, then its content; null for no value."""
    b = col(b)
    flags = F.conv(F.hex(F.substring(b, 2, 1)), 16, 10).cast("int")
    content = F.when(flags.bitwiseAND(F.lit(8)) == 0, F.substring(b, 5, 4)).otherwise(F.substr(b, F.lit(9), F.octet_length(b) - 8 - flags.bitwiseAND(F.lit(7))))
    return F.concat(F.substring(b, 3, 2), content)


def order_key(json, mode: str = "content", depth: int = DEPTH) -> Column:
    """Key of JSON text in either order: "content" (see sort_key) or "bytes" (of the value's binary form)."""
    if mode == "content":
        return sort_key(V.parsed(json), depth)
    if mode == "bytes":
        from ..sources.value_files import encoded

        return byte_order_key(encoded(F.when(V.parsed(json).isNotNull(), col(json))))
    raise ValueError("mode is content or bytes")


def compared(a, b) -> Column:
    """-1, 0 or 1 as key a comes before, with or after key b."""
    a, b = col(a), col(b)
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def ordered(items, assume: bool = False) -> Column:
    """An array in order; with assume it is taken to be so already."""
    return col(items) if assume else F.array_sort(col(items))

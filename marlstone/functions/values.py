"""Self-describing values as columns: type, navigation by name and position, checked narrowing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Rank of each kind of value in the order over all kinds (fixed values).
TYPE_RANK = {"Unit": 0, "Bool": 1, "SignedInt": 2, "UnsignedInt": 3, "Float": 4, "Tuple": 5, "Vec": 6, "VecBasic": 7, "VecBool": 8, "Map": 9, "Object": 10, "Document": 11, "String": 12, "UnicodeChar": 13, "UUID": 14, "CryptoHash": 15, "EncryptedPassword": 16, "PublicKey": 17, "PrivateKey": 18, "KeyPair": 19, "Signature": 20, "SignedExtent": 21, "SignedValue": 22, "EncryptedExtent": 23, "EncryptedValue": 24, "CiphertextMetadata": 25, "TxLog": 26, "Unknown": 27, "DateTime": 28}
ERROR_RANK = 99


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parsed(json) -> Column:
    """A VARIANT, null where the text is malformed (what follows a whole value is not read)."""
    return F.try_parse_json(col(json))


def kind(v) -> Column:
    """Name of a VARIANT's kind; null for a malformed value.

    Integers beyond 64 bits, up to 38 digits, are integers too: those above zero are unsigned.
    """

    def named(s):
        wide = s.rlike("^DECIMAL[(][0-9]+,0[)]$") & F.try_variant_get(v, "$", "bigint").isNull()
        return (
            F.when(s == "VOID", "Unit").when(s == "BOOLEAN", "Bool").when(s == "BIGINT", "SignedInt")
            .when(wide, F.when(F.try_variant_get(v, "$", "decimal(38,0)") < 0, "SignedInt").otherwise("UnsignedInt"))
            .when(s.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "Float").when(s == "STRING", "String").when(s.startswith("ARRAY"), "Vec")
            .when(s.startswith("OBJECT"), "Object").when(s.isNotNull(), "Unknown")
        )

    return let(F.schema_of_variant(v), named)


def typed(v, kind_: str) -> Column:
    """An integer of one signedness as decimal(38,0): null if it is malformed or of any other kind, even if its value would fit."""
    if kind_ not in ("SignedInt", "UnsignedInt"):
        raise ValueError("SignedInt or UnsignedInt")
    return F.when(kind(v) == kind_, F.try_variant_get(v, "$", "decimal(38,0)"))


def record_error(json, type_name: str, fields: list[str], strict: bool = False) -> Column:
    """What keeps JSON text from being a record of this type: null if nothing does.

    Its own type_name must be the one asked for and all fields must be there;
    in strict mode there may be no others.
    """
    keys = field_names(json)
    missing = F.array_except(F.array(*map(F.lit, fields)), keys)
    extra = F.array_except(keys, F.array(F.lit("type_name"), *map(F.lit, fields)))
    named = field(parsed(json), "type_name", "string")
    wrong = F.coalesce(named, F.lit("")) != type_name
    found = (
        F.when(parsed(json).isNull(), "malformed").when(keys.isNull(), "not a record").when(wrong, F.concat(F.lit("wrong type: "), F.coalesce(named, F.lit("none"))))
        .when(F.size(missing) > 0, F.concat(F.lit("missing field: "), F.get(missing, F.lit(0))))
    )
    return found.when(F.size(extra) > 0, F.concat(F.lit("unexpected field: "), F.get(extra, F.lit(0)))) if strict else found


def rank_of(name: Column) -> Column:
    pairs = [F.lit(x) for kv in TYPE_RANK.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), F.lit(ERROR_RANK))


def field(v, name: str, kind_: str) -> Column:
    """A record's field by name; null if missing or not of the kind."""
    return F.try_variant_get(v, f"$.{name}", kind_)


def field_names(json) -> Column:
    return F.json_object_keys(col(json))


def fits(x, low: int, high: int) -> Column:
    """x as a number if it lies in [low, high], else null: a checked narrowing."""
    return F.when(col(x).between(F.lit(low), F.lit(high)), col(x))


def likely_text(b) -> Column:
    """Text if the bytes are UTF-8, else their hex digits."""
    return F.coalesce(F.try_validate_utf8(col(b).cast("string")), F.hex(col(b)))


def hex_dump(b, every: int = 4) -> Column:
    """Hex digits in groups of `every` bytes."""
    return F.rtrim(F.regexp_replace(F.lower(F.hex(col(b))), f"(.{{{2 * every}}})", "$1 "))


def nanos(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp")).cast("decimal(38,0)") * 1000


def micros_of_nanos(n) -> Column:
    """Microseconds, rounded down, so that times before 1970 keep their order."""
    return F.expr(f"CAST(({n} - pmod({n}, 1000)) div 1000 AS BIGINT)")

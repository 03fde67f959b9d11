"""Packed vectors, bit vectors, documents and transactions as columns in their binary form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import wire
from .values import col



def row(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(c, t) for c, t in columns.items()])


TEXT, TEXTS = T.StringType(), T.ArrayType(T.StringType())
TENSOR = row(element=TEXT, dims=T.ArrayType(T.IntegerType()), data=T.ArrayType(T.DoubleType()))
PREVIOUS = T.ArrayType(row(document=TEXT, from_tx=TEXT))


def packed(values, element: str = "f64", dims: tuple = ()) -> Column:
    """Binary form of an array of numbers as a packed vector of one element type; null where a value does not fit it.

    dims are the lengths of a tensor of which the array is the rows; null where they do not hold the array.
    """
    if element not in wire.ELEMENTS or not wire.ELEMENTS[element][2]:
        raise ValueError(f"no column of {element}")
    code = wire.ELEMENTS[element][2]

    @F.pandas_udf(T.BinaryType())
    def pack(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                v = wire.Packed(element, tuple(float(y) for y in x) if code in "fd" else tuple(int(y) for y in x), dims)
                return wire.encode(v)
            except (wire.Malformed, TypeError, ValueError):  # a null among them, or one too large
                return None

        return pd.Series([None if x is None else one(x) for x in s], dtype=object)

    return pack(col(values))


@F.pandas_udf(TENSOR)
def _unpacked(s: pd.Series) -> pd.DataFrame:
    rows = []
    for b in s:
        try:
            v = None if b is None else wire.decode(bytes(b))
        except wire.Malformed:
            v = None
        ok = isinstance(v, wire.Packed) and bool(wire.ELEMENTS[v.element][2])
        rows.append((v.element, list(v.dims or (len(v.values),)), np.array(v.values, np.float64)) if ok else (None, None, None))
    return pd.DataFrame(rows, columns=["element", "dims", "data"])


def unpacked(b) -> Column:
    """Element type, dimensions and elements of a packed vector of numbers; nulls for anything else."""
    return _unpacked(col(b))


@F.pandas_udf(T.BinaryType())
def _bits(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else wire.encode(wire.Bits(tuple(bool(y) for y in x))) for x in s], dtype=object)


def packed_bits(bits) -> Column:
    """Binary form of an array of booleans of any length as a bit vector."""
    return _bits(col(bits))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _unpacked_bits(s: pd.Series) -> pd.Series:
    def one(b):
        try:
            v = wire.decode(bytes(b))
        except wire.Malformed:
            return None
        return list(v.values) if isinstance(v, wire.Bits) else None

    return pd.Series([None if b is None else one(b) for b in s], dtype=object)


def unpacked_bits(b) -> Column:
    return _unpacked_bits(col(b))


@F.pandas_udf(T.BinaryType())
def _document(ids: pd.Series, bodies: pd.Series, previous: pd.Series) -> pd.Series:
    def one(i, b, p):
        if i is None or b is None or p is None:
            return None
        pairs = tuple((bytes.fromhex(x["document"]), bytes.fromhex(x["from_tx"])) for x in p)
        return wire.encode(wire.Document(wire.encode(i), wire.encode(b), pairs))

    return pd.Series([one(*row) for row in zip(ids, bodies, previous)], dtype=object)


def encoded_document(doc_id, body, prev_versions) -> Column:
    """Binary form of a document: id and body as texts, and the versions it replaces."""
    return _document(col(doc_id).cast("string"), col(body).cast("string"), col(prev_versions))


@F.pandas_udf(row(id=TEXT, body=TEXT, prev_versions=PREVIOUS))
def _read_document(s: pd.Series) -> pd.DataFrame:
    rows = []
    for b in s:
        try:
            v = None if b is None else wire.decode(bytes(b))
            ok = isinstance(v, wire.Document)
            rows.append((wire.decode(v.id), wire.decode(v.body), [{"document": d.hex(), "from_tx": t.hex()} for d, t in v.previous]) if ok else (None, None, None))
        except wire.Malformed:
            rows.append((None, None, None))
    return pd.DataFrame(rows, columns=["id", "body", "prev_versions"])


def decoded_document(b) -> Column:
    """id, body and prev_versions of a document's binary form; nulls for anything else."""
    return _read_document(col(b))

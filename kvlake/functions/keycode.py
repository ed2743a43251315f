"""Order-preserving key encoding: typed values as BINARY whose unsigned byte order is the values' order.

  BOOLEAN          00 or 01
  BIGINT           big-endian with the sign bit flipped
  DECIMAL(20,0)    unsigned 64-bit, big-endian
  DOUBLE           IEEE 754 big-endian; the sign bit flipped, or all bits of negative numbers: -0.0 is below 0.0
  BINARY, STRING   bytes (UTF-8) with 00 written as 00ff, closed by 0000
  STRUCT           its fields one after another
  ARRAY            its elements one after another, decodable in the last place only

Everything but DOUBLE is built-in expressions; Spark has none for a double's bits, so that goes through Arrow, as arrays.
Keys may be of any length: patterns are possessive, which Java's matcher runs as a loop rather than by recursion. Encoders
of null give null. The encoding doesn't describe itself: decoders are told the types. Decoders fail on trailing or missing
bytes, escapes that don't exist and text that isn't UTF-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlake.session import find_package

_SIGN = -(2**63)
_TWO_63 = "9223372036854775808"


def encode_bool(v: Column) -> Column:
    return F.when(v.isNull(), F.lit(None).cast("binary")).otherwise(F.unhex(F.when(v, F.lit("01")).otherwise(F.lit("00"))))


def encode_i64(v: Column) -> Column:
    return F.unhex(F.lpad(F.hex(v.cast("bigint").bitwiseXOR(F.lit(_SIGN))), 16, "0"))


def encode_u64(v: Column) -> Column:
    return F.unhex(F.lpad(F.conv(v.cast("decimal(20,0)").cast("string"), 10, 16), 16, "0"))


def encode_bytes(v: Column) -> Column:
    # \G keeps the matches on byte boundaries: 10 01 has no zero byte.
    return F.unhex(F.concat(F.regexp_replace(F.hex(v), r"\G((?:(?!00)..)*+)00", "$100FF"), F.lit("0000")))


def encode_string(v: Column) -> Column:
    return encode_bytes(F.encode(v, "UTF-8"))


_TOP = np.uint64(1 << 63)


def _doubles_out(v: pa.Array) -> pa.Array:
    bits = np.asarray(v.fill_null(0.0), np.float64).view(np.uint64)
    raw = np.where(bits & _TOP, ~bits, bits ^ _TOP).astype(">u8")
    made = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(v), [None, pa.py_buffer(raw.tobytes())])
    return pc.if_else(v.is_valid(), made.cast(pa.binary()), None)


def _doubles_in(b: pa.Array) -> pa.Array:
    if pc.any(pc.not_equal(pc.binary_length(b), 8)).as_py():
        raise ValueError("a double has eight bytes")
    raw = np.frombuffer(b"".join(b.fill_null(bytes(8)).to_pylist()), ">u8").astype(np.uint64)
    return pc.if_else(b.is_valid(), pa.array(np.where(raw & _TOP, raw ^ _TOP, ~raw).view(np.float64)), None)


def _f64_udfs():
    find_package()

    @F.arrow_udf("binary")
    def encode(v: pa.Array) -> pa.Array:
        return _doubles_out(v)

    @F.arrow_udf("double")
    def decode(b: pa.Array) -> pa.Array:
        return _doubles_in(b)

    return encode, decode


def encode_f64(v: Column) -> Column:
    return _f64_udfs()[0](v.cast("double"))


def decode_f64(b: Column) -> Column:
    return _f64_udfs()[1](b)


def encode_tuple(*encoded: Column) -> Column:
    return F.concat(*encoded)


def encode_array(v: Column, element) -> Column:
    """An array of values that element encodes; an empty one is no bytes."""
    return F.aggregate(F.transform(v, element), F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x))


def encode_variant(tag: Column | int, *encoded: Column) -> Column:
    tag = F.lit(tag) if isinstance(tag, int) else tag
    return F.concat(F.unhex(F.lpad(F.hex(tag.cast("bigint")), 2, "0")), *encoded)


#: Encoders by Spark type; other types have no key encoding.
_ENCODERS = {"boolean": encode_bool, "bigint": encode_i64, "decimal(20,0)": encode_u64, "double": encode_f64, "binary": encode_bytes, "string": encode_string}


def encode(v: Column, kind: T.DataType | str) -> Column:
    """The encoding of a column of the type."""
    kind = T._parse_datatype_string(kind) if isinstance(kind, str) and kind not in _ENCODERS else kind
    if isinstance(kind, T.StructType):
        return encode_tuple(*(encode(v[f.name], f.dataType) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return encode_array(v, lambda x: encode(x, kind.elementType))
    name = kind if isinstance(kind, str) else kind.simpleString()
    if name not in _ENCODERS:
        raise TypeError(f"no key encoding for {name}")
    return _ENCODERS[name](v)


def _fail(message: str) -> Column:
    return F.raise_error(F.lit(message))


def decode_bool(b: Column) -> Column:
    return F.when(F.hex(b) == "01", True).when(F.hex(b) == "00", False).when(b.isNull(), None).otherwise(_fail("a boolean is 00 or 01").cast("boolean"))


def decode_i64(b: Column) -> Column:
    number = F.conv(F.hex(b), 16, 10).cast("decimal(20,0)") - F.lit(_TWO_63).cast("decimal(20,0)")
    return F.when(F.octet_length(b) == 8, number.cast("bigint")).when(b.isNull(), None).otherwise(_fail("a number has eight bytes").cast("bigint"))


def decode_u64(b: Column) -> Column:
    return F.when(F.octet_length(b) == 8, F.conv(F.hex(b), 16, 10).cast("decimal(20,0)")).when(b.isNull(), None).otherwise(_fail("a number has eight bytes").cast("decimal(20,0)"))


def decode_bytes(b: Column) -> Column:
    h = F.hex(b)
    fine = h.rlike("^(?:(?!00)..|00FF)*+0000$")
    body = F.regexp_replace(F.substring(h, F.lit(1), F.length(h) - 4), r"\G((?:(?!00)..)*+)00FF", "$100")
    return F.when(fine, F.unhex(body)).when(b.isNull(), None).otherwise(_fail("a bad escape or no end").cast("binary"))


def decode_string(b: Column) -> Column:
    raw = decode_bytes(b)
    return F.when(raw.isNull() | F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(_fail("text that isn't UTF-8").cast("string"))


_WIDTHS = {"boolean": 1, "bigint": 8, "decimal(20,0)": 8, "double": 8}
_DECODERS = {"boolean": decode_bool, "bigint": decode_i64, "decimal(20,0)": decode_u64, "double": decode_f64, "binary": decode_bytes, "string": decode_string}


def decode(b: Column, kind: str) -> Column:
    if kind not in _DECODERS:
        raise TypeError(f"no key encoding for {kind}")
    return _DECODERS[kind](b)


def decode_tuple(b: Column, *kinds: str) -> Column:
    """A struct of fields _1, _2, ... of the kinds. Each field's bytes are cut off in turn; none may be left."""
    fields, rest = [], F.hex(b)
    for i, kind in enumerate(kinds, 1):
        if kind in _WIDTHS:
            size = F.lit(2 * _WIDTHS[kind])
        else:
            size = F.length(F.regexp_extract(rest, "^(?:(?!00)..|00FF)*+0000", 0))
        part = F.substring(rest, F.lit(1), size)
        fields.append(decode(F.unhex(part), kind).alias(f"_{i}"))
        rest = F.substring(rest, size + 1, F.length(rest))
    return F.when(F.length(rest) > 0, _fail("bytes left over").cast("void")).otherwise(F.struct(*fields)) if kinds else F.struct()

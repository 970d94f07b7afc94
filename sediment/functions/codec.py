"""Sizes and bytes of log records, table records and wire frames, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUT, DELETE = 1, 2
FOOTER_BYTES = 20
# Fixed message types of the wire format.
PUT_REQUEST, GET_REQUEST, DELETE_REQUEST = 0x01, 0x02, 0x03
PUT_RESPONSE, GET_RESPONSE, DELETE_RESPONSE, ERROR_RESPONSE = 0x81, 0x82, 0x83, 0xFF
# Fixed error texts.
MALFORMED = "malformed or non-request message"
NO_NODE = "no compute node available for this key"
UNEXPECTED = "unexpected message type for a request"


def length(text: Column) -> Column:
    """Bytes; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def log_bytes(op: Column, key: Column, value: Column) -> Column:
    """A log record: type 1, sequence 8, key length 4, key, and for a put value length 4, value."""
    return F.when(op == PUT, 17 + length(key) + length(value)).otherwise(13 + length(key))


def table_bytes(op: Column, key: Column, value: Column) -> Column:
    """A table record: type 1, key length 4, key, and for a put value length 4, value."""
    return F.when(op == PUT, 9 + length(key) + length(value)).otherwise(5 + length(key))


def index_bytes(key: Column) -> Column:
    return 12 + length(key)


def file_name(generation: Column) -> Column:
    """Six digits at least; more are never cut."""
    return F.format_string("%06d.sst", generation)


def u32(n: Column) -> Column:
    """Hex of a number's four little-endian bytes."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)])


def counted(text: Column) -> Column:
    """Hex of a length and its bytes."""
    return F.concat(u32(length(text)), F.hex(text.cast("binary")))


def frame(kind: int, *parts: Column) -> Column:
    """Hex of a frame: length of what follows, message type, parts."""
    body = F.concat(F.lit(f"{kind:02X}"), *parts)
    return F.concat(u32(F.length(body) / 2), body)


def flag(value: Column) -> Column:
    return F.when(value, F.lit("01")).otherwise(F.lit("00"))


def put_request(key: Column, value: Column) -> Column:
    return frame(PUT_REQUEST, counted(key), counted(value))


def get_request(key: Column) -> Column:
    return frame(GET_REQUEST, counted(key))


def delete_request(key: Column) -> Column:
    return frame(DELETE_REQUEST, counted(key))


def put_response(ok: Column) -> Column:
    return frame(PUT_RESPONSE, flag(ok))


def delete_response(ok: Column) -> Column:
    return frame(DELETE_RESPONSE, flag(ok))


def get_response(found: Column, value: Column) -> Column:
    return frame(GET_RESPONSE, flag(found), counted(F.when(found, value).otherwise(F.lit(""))))


def error_response(message: Column) -> Column:
    return frame(ERROR_RESPONSE, counted(message))


def _number(h: Column, at: Column) -> Column:
    """The little-endian number in eight hex digits from a place (from 1) on."""
    order = F.concat(*[F.substring(h, at + 2 * k, F.lit(2)) for k in (3, 2, 1, 0)])
    return F.conv(order, 16, 10).cast("long")


def _text(h: Column, at: Column) -> tuple[Column, Column]:
    """(hex of the counted bytes from a place on, the place after them); null if they are cut short."""
    fits = F.length(h) >= at + 7
    size = F.when(fits, _number(h, at))
    end = at + 8 + 2 * size
    return F.when(F.length(h) + 1 >= end, F.substring(h, at + 8, (2 * size).cast("int"))), end


def decode(payload: Column) -> Column:
    """(msg_type, key_hex, value_hex, flag, message_hex) of a payload in hex; null if it is malformed. Bytes after a whole message are let be."""
    kind = F.when(F.length(payload) >= 2, F.conv(F.substring(payload, 1, 2), 16, 10).cast("int"))
    at = F.lit(3)
    first, after = _text(payload, at)
    second, _ = _text(payload, after.cast("int"))
    bit = F.when(F.length(payload) >= 4, F.substring(payload, 3, 2) != "00")
    behind, _ = _text(payload, F.lit(5))
    none = F.lit(None).cast("string")
    unset = F.lit(None).cast("boolean")

    def message(key=none, value=none, flag_=unset, text=none) -> Column:
        return F.struct(kind.alias("msg_type"), key.alias("key_hex"), value.alias("value_hex"), flag_.alias("flag"), text.alias("message_hex"))

    return (
        F.when((kind == PUT_REQUEST) & first.isNotNull() & second.isNotNull(), message(key=first, value=second))
        .when(kind.isin(GET_REQUEST, DELETE_REQUEST) & first.isNotNull(), message(key=first))
        .when(kind.isin(PUT_RESPONSE, DELETE_RESPONSE) & bit.isNotNull(), message(flag_=bit))
        .when((kind == GET_RESPONSE) & bit.isNotNull() & behind.isNotNull(), message(value=behind, flag_=bit))
        .when((kind == ERROR_RESPONSE) & first.isNotNull(), message(text=first))
    )

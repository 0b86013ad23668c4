"""Detection and decoding of byte payloads held in JSON text."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Leading bytes -> media type, tested in this order.
MAGIC_BYTES = (
    ("89504E47", 8, "image/png"),
    ("FFD8FF", 3, "image/jpeg"),
    ("47494638", 4, "image/gif"),
    ("25504446", 4, "application/pdf"),
    ("504B0304", 4, "application/zip"),
    ("1F8B", 2, "application/gzip"),
)

DATA_URL = r"^data:([^;,]++);base64,[^\n\r]++$"


def is_base64(text: Column) -> Column:
    """At least 16 characters, length a multiple of 4, base64 alphabet."""
    size = F.length(text)
    return (size >= 16) & (size % 4 == 0) & text.rlike(r"\A[A-Za-z0-9+/]++={0,2}\z")


def data_url_media(text: Column) -> Column:
    return F.regexp_extract(text, DATA_URL, 1)


def data_url_payload(text: Column) -> Column:
    """Text after the first comma."""
    return F.substr(text, F.instr(text, ",") + 1)


def is_byte_array(numbers: Column) -> Column:
    """At least 8 whole numbers in 0..255; ``numbers`` is ARRAY<DOUBLE>."""
    ok = F.forall(
        numbers, lambda x: x.isNotNull() & (x == F.floor(x)) & (x >= 0) & (x <= 255)
    )
    return F.coalesce((F.size(numbers) >= 8) & ok, F.lit(False))


def bytes_of(numbers: Column) -> Column:
    """ARRAY<DOUBLE> of byte values as BINARY."""
    return F.unhex(
        F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")), "")
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _unbase64_lenient(text: Column) -> Column:
    clean = F.regexp_replace(F.replace(F.replace(text, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/")), r"[^A-Za-z0-9+/]+", "")

    def padded(clean: Column) -> Column:
        size = F.length(clean)
        whole = F.when(size % 4 == 1, F.left(clean, size - 1)).otherwise(clean)
        return F.rpad(whole, (F.ceil((size - F.when(size % 4 == 1, 1).otherwise(0)) / 4) * 4).cast("int"), F.lit("="))

    return F.unbase64(_once(clean, padded))


def from_base64(text: Column) -> Column:
    """Lenient base64: characters outside the alphabet are skipped."""
    return _once(text, lambda t: F.when(is_base64(t), F.unbase64(t)).otherwise(_unbase64_lenient(t)))


@F.pandas_udf(T.BinaryType())
def _inflate(data: pd.Series) -> pd.Series:
    def one(raw):
        try:
            return zlib.decompress(bytes(raw), wbits=31)
        except zlib.error:
            return None

    return data.map(lambda raw: None if raw is None else one(raw))


def gunzip(data: Column) -> Column:
    """Decompressed bytes when ``data`` is gzip, else NULL."""
    looks_gzip = F.hex(F.substring(data, 1, 2)) == "1F8B"
    return F.when(looks_gzip, _inflate(F.when(looks_gzip, data)))


def as_text(data: Column) -> Column:
    """Bytes read as UTF-8, invalid sequences replaced."""
    return F.make_valid_utf8(data.cast("string"))


def looks_textual(text: Column) -> Column:
    """Few control characters: at most one, or two percent of the text."""
    controls = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]+", ""))
    allowed = F.greatest(F.lit(1), F.floor(F.length(text) * 0.02))
    return (F.length(text) > 0) & (controls <= allowed)


def magic_media_type(data: Column) -> Column:
    """Media type told by the first bytes, NULL when none matches."""
    head = F.hex(F.substring(data, 1, 4))
    out = None
    for magic, least, media in MAGIC_BYTES:
        test = head.startswith(magic) & (F.octet_length(data) >= least)
        out = F.when(test, media) if out is None else out.when(test, media)
    return out


def _text_media_type(text: Column) -> Column:
    edges = F.concat(F.left(F.trim(text), F.lit(1)), F.right(F.trim(text), F.lit(1)))
    is_json = F.when(edges.isin("{}", "[]"), F.try_parse_json(F.trim(text)).isNotNull())
    return F.when(
        looks_textual(text),
        F.when(F.coalesce(is_json, F.lit(False)), "application/json").otherwise("text/plain"),
    ).otherwise("application/octet-stream")


def sniff_media_type(data: Column) -> Column:
    return F.coalesce(magic_media_type(data), _text_media_type(as_text(data)))


def decoded_kind(media_type: Column) -> Column:
    return (
        F.when(media_type == "application/json", "json")
        .when(media_type.startswith("text/"), "text")
        .otherwise("binary")
    )

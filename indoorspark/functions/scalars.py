"""Columns of values as project documents hold them: missing values, labels, ids, coordinates as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: pixels of the canvas in one coordinate unit.
PIXELS = 100000.0
# Fixed value: an id of the workplace directory.
GUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
# Fixed value: the part of a text that reads as a number.
NUMBER = r"^\s*([-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?)"


def text_or(*values) -> Column:
    """The first value that is neither null nor empty; the last one stands in."""
    *first, last = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return F.coalesce(*[F.when(v != "", v) for v in first], last)


def number_prefix(text: Column) -> Column:
    """The number that a text starts with, else null."""
    return F.nullif(F.regexp_extract(text, NUMBER, 1), F.lit("")).cast("double")


def parse_lat_lon(text: Column) -> Column:
    """array<double> of the two numbers of "a, b" (each null if it isn't one); [0, 0] unless there are exactly two parts."""
    two = F.split(text, ",")
    return F.when(F.size(two) == 2, F.transform(two, number_prefix)).otherwise(F.array(F.lit(0.0), F.lit(0.0)))


def venue_origin(coords: Column) -> Column:
    """struct<lon, lat>, null without two values or for 0, 0; a first value beyond 90 is the longitude. A null value counts as 0."""
    a, b = (F.coalesce(F.try_element_at(coords, F.lit(i)), F.lit(0.0)) for i in (1, 2))
    point = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    return F.when((F.size(coords) >= 2) & ((a != 0) | (b != 0)), F.when(F.abs(a) > 90, point(a, b)).otherwise(point(b, a)))


def labels(value: Column) -> Column:
    """{"en": text}; null for null or empty text."""
    return F.when(value.isNotNull() & (value.cast("string") != ""), F.create_map(F.lit("en"), value.cast("string")))


def map_labels(value: Column) -> Column:
    """A map of labels stays unless it is empty."""
    return F.when(F.size(value) > 0, value)


def extract_place_id(text: Column) -> tuple[Column, Column]:
    """(id, rejected): the only directory id in the text, lower-cased. Text without exactly one is rejected; blank text is not."""
    found = F.regexp_extract_all(text, F.lit(GUID), F.lit(0))
    blank = F.coalesce(F.trim(F.regexp_replace(text, r"\s", " ")) == "", F.lit(True))
    one = F.size(found) == 1
    return F.when(~blank & one, F.lower(found[0])), ~blank & ~one


def category(value: Column) -> Column:
    return text_or(F.when(value == "conference", "conferenceroom").otherwise(value), "unspecified")


def twin_id(id_: Column) -> Column:
    """The id with each hexadecimal digit of its last block turned over (15 - digit)."""
    tail = F.translate(F.lower(F.substring(id_, 25, 1000)), "0123456789abcdef", "fedcba9876543210")
    return F.concat(F.substring(id_, 1, 24), tail)


def piece_id(id_: Column, i: Column) -> Column:
    """Piece 0 keeps the id; others get their number, in hexadecimal, as the last three characters."""
    number = F.lower(F.hex(i.cast("long")))
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), 3 - F.length(number))), number)
    return F.when(i == 0, id_).otherwise(F.concat(F.substring(id_, F.lit(1), F.greatest(F.length(id_) - 3, F.lit(0))), padded))


def decor_id(building: Column, level: Column, tag: str | Column, i: Column) -> Column:
    """A stable id of UUID form for a drawn-only shape, from the SHA-1 of building|level|tag|i."""
    hexed = F.sha1(F.concat_ws("|", building, level, F.lit(tag) if isinstance(tag, str) else tag, i.cast("string")))
    cut = lambda a, b: F.substring(hexed, a + 1, b - a)
    return F.concat(cut(0, 8), F.lit("-"), cut(8, 12), F.lit("-4"), cut(13, 16), F.lit("-a"), cut(17, 20), F.lit("-"), cut(20, 32))


def js_round(x: Column) -> Column:
    """Half goes up, also below zero."""
    return F.floor(x + 0.5)


def csv_field(value: Column) -> Column:
    """Quoted only if it holds a quote, comma or line break; quotes doubled; null is empty."""
    v = F.coalesce(value, F.lit(""))
    return F.when(v.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

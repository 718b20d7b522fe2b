"""Resource values of archives, from their binary resource tables (protocol buffers of aapt2's public Resources.proto).

Only the wire format is read, package by package, so a table never becomes a tree of objects.  A configuration comes out as the
lines `key: value` that a textual dump has, so both forms share the rule that turns such lines into a folder qualifier.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.manifests import wire
from kindred.sources.parsers import resource_qualifier

# --- fixed values of the format: fields of messages by number ---
TABLE_PACKAGE, PACKAGE_TYPE, TYPE_NAME, TYPE_ENTRY, ENTRY_NAME, ENTRY_VALUE = 2, 3, 2, 3, 2, 6
CONFIG, VALUE, ITEM, COMPOUND = 1, 2, 4, 5
#: Fields of Configuration that are numbers or texts, and those that are enumerations, with their words from 1 on.
PLAIN = {1: "mcc", 2: "mnc", 3: "locale", 5: "screen_width", 6: "screen_height", 7: "screen_width_dp", 8: "screen_height_dp", 9: "smallest_screen_width_dp", 18: "density", 24: "sdk_version", 25: "product"}
ENUMS = {
    4: ("layout_direction", ("LTR", "RTL")),
    10: ("screen_layout_size", ("SMALL", "NORMAL", "LARGE", "XLARGE")),
    11: ("screen_layout_long", ("LONG", "NOTLONG")),
    12: ("screen_round", ("ROUND", "NOTROUND")),
    13: ("wide_color_gamut", ("WIDECG", "NOWIDECG")),
    14: ("hdr", ("HIGHDR", "LOWDR")),
    15: ("orientation", ("PORT", "LAND", "SQUARE")),
    16: ("ui_mode_type", ("NORMAL", "DESK", "CAR", "TELEVISION", "APPLIANCE", "WATCH", "VRHEADSET")),
    17: ("ui_mode_night", ("NIGHT", "NOTNIGHT")),
    19: ("touchscreen", ("NOTOUCH", "STYLUS", "FINGER")),
    20: ("keys_hidden", ("KEYSEXPOSED", "KEYSHIDDEN", "KEYSSOFT")),
    21: ("keyboard", ("NOKEYS", "QWERTY", "TWELVEKEY")),
    22: ("nav_hidden", ("NAVEXPOSED", "NAVHIDDEN")),
    23: ("navigation", ("NONAV", "DPAD", "TRACKBALL", "WHEEL")),
}
UNITS = ("px", "dp", "sp", "pt", "in", "mm")
COLORS = {9: 8, 10: 6, 11: 4, 12: 3}  # of Primitive: hex digits
QUANTITIES = ("zero", "one", "two", "few", "many", "other")
# --- end of the fixed values ---


def _first(data: bytes, field: int, default=None):
    return next((v for f, _, v in wire(data) if f == field), default)


def _text(data) -> str:
    return data.decode("utf-8", "replace") if isinstance(data, bytes) else ""


def configuration(data: bytes) -> list[str]:
    """Lines `key: value` in the order of the fields; `(default)` if none is set."""
    out = []
    for field, _, value in sorted(wire(data), key=lambda x: x[0]):
        if field in PLAIN:
            out.append(f'{PLAIN[field]}: "{_text(value)}"' if isinstance(value, bytes) else f"{PLAIN[field]}: {value}")
        elif field in ENUMS and isinstance(value, int) and value:
            key, words = ENUMS[field]
            out.append(f"{key}: {key.upper()}_{words[value - 1]}" if value <= len(words) else f"{key}: {value}")
        elif value:
            out.append(f"field_{field}: {value}")
    return [x for x in out if not x.endswith((': ""', ": 0"))] or ["(default)"]


def _complex(value: int, units) -> str:
    """A number of 24 bits with a radix, and its unit."""
    mantissa = (value >> 8) - ((value >> 31) << 24)
    number = mantissa / (1, 1 << 7, 1 << 15, 1 << 23)[value >> 4 & 3]
    unit = value & 15
    return f"{number:g}{units[unit] if unit < len(units) else ''}"


def _primitive(data: bytes) -> str:
    for field, _, value in wire(data):
        if field in COLORS:
            digits = COLORS[field]
            channels = f"{value & 0xFFFFFFFF:08x}"
            return "#" + {8: channels, 6: channels[2:], 4: channels[::2], 3: channels[2::2]}[digits]
        if field == 8:
            return "true" if value else "false"
        if field == 6:
            return str(value - (1 << 64) if value >> 63 else value - (1 << 32) if value >> 31 == 1 else value)
        if field == 7:
            return f"0x{value & 0xFFFFFFFF:x}"
        if field in (3, 4, 5):
            return f"{struct.unpack('<f', value)[0]:g}"
        if field == 13:
            return _complex(value & 0xFFFFFFFF, UNITS)
        if field == 14:
            return _complex(value & 0xFFFFFFFF, ("%", "%p"))
        return "[NULL]" if field == 1 else "[EMPTY]"
    return "[NULL]"


def _reference(data: bytes) -> str:
    kind, number, name = (_first(data, f) for f in (1, 2, 3))
    return ("?" if kind == 1 else "@") + (_text(name) or (f"0x{number:08x}" if number else "null"))


def _item(data: bytes) -> str:
    for field, _, value in wire(data):
        if field == 1:
            return _reference(value)
        if field in (2, 3, 4):
            return f'"{_text(_first(value, 1, b""))}"'
        if field == 5:
            return _text(_first(value, 1, b""))
        if field == 6:
            return "[ID]"
        if field == 7:
            return _primitive(value)
    return "[EMPTY]"


def _compound(data: bytes) -> str:
    for field, _, value in wire(data):
        if field == 2:  # a style: parent, then entries of key and item
            return "[" + ", ".join(_item(_first(v, 4, b"")) for f, _, v in wire(value) if f == 3) + "]"
        if field == 3:  # a styleable: entries of an attribute
            return "[" + ", ".join(_reference(_first(v, 3, b"")) for f, _, v in wire(value) if f == 1) + "]"
        if field == 4:
            return "[" + ", ".join(_item(_first(v, 3, b"")) for f, _, v in wire(value) if f == 1) + "]"
        if field == 5:
            return "[" + ", ".join(f"{QUANTITIES[_first(v, 3, 0) % 6]}={_item(_first(v, 4, b''))}" for f, _, v in wire(value) if f == 1) + "]"
        return "[ATTR]" if field == 1 else "[MACRO]"
    return "[EMPTY]"


def value_text(data: bytes) -> str:
    """Of a Value: a stable text, with white space run together."""
    shown = next((_item(v) if f == ITEM else _compound(v) for f, _, v in wire(data) if f in (ITEM, COMPOUND)), "[EMPTY]")
    return " ".join(shown.split())


def values(data: bytes) -> Iterator[tuple[str, str, list[str] | None, str | None]]:
    """(type, name, configuration lines, value) of every value in document order; an entry that has none, or cannot be read, is a row
    without lines.  ValueError if the table itself cannot be read."""
    for field, kind, package in wire(data):
        if (field, kind) != (TABLE_PACKAGE, 2):
            continue
        for f, t, listed in wire(package):
            if (f, t) != (PACKAGE_TYPE, 2):
                continue
            name = _text(_first(listed, TYPE_NAME, b""))
            for g, u, entry in wire(listed):
                if (g, u) == (TYPE_ENTRY, 2):
                    own = _text(_first(entry, ENTRY_NAME, b""))
                    try:
                        rows = [(name, own, configuration(_first(v, CONFIG, b"")), value_text(_first(v, VALUE, b""))) for h, w, v in wire(entry) if (h, w) == (ENTRY_VALUE, 2)]
                    except (ValueError, struct.error, TypeError, AttributeError):
                        rows = []
                    yield from rows or [(name, own, None, None)]


RAW = "archive string, path string, pos long, type string, name string, config array<string>, value string, problem string"


def _decoded(batches):
    names = [x.split()[0] for x in RAW.split(", ")]
    types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    for batch in batches:
        for archive, path, data in zip(*(batch.column(k) for k in range(3)), strict=True):
            rows = []
            try:
                for k, (kind, name, config, value) in enumerate(values(data.as_py() or b"")):
                    rows.append((archive.as_py(), path.as_py(), k, kind, name, config, value, None))
                    if len(rows) == 5000:
                        yield made(rows)
                        rows = []
            except (ValueError, TypeError, AttributeError) as error:
                rows.append((archive.as_py(), path.as_py(), -1, None, None, None, None, str(error)))
            if rows:
                yield made(rows)


def raw_values(contents: DataFrame) -> DataFrame:
    """Rows of RAW for the resource tables among contents (archive, path, content)."""
    return contents.where(F.col("path").rlike("^[^/]+/resources[.]pb$")).select("archive", "path", "content").mapInArrow(_decoded, RAW)


def inventory(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(archive, type, qualifiers, name, value), the last value of each winning, and (archive, declared, covered, broken) of the tables."""
    rows = raw.where("config is not null").withColumn("qualifiers", resource_qualifier(F.col("config"))).where("qualifiers is not null")
    last = rows.groupBy("archive", "type", "qualifiers", "name").agg(F.max_by("value", F.struct("path", "pos")).alias("value"))
    declared = raw.groupBy("archive").agg(F.count_distinct("type", "name").alias("declared"), F.count("problem").alias("broken"))
    covered = last.groupBy("archive").agg(F.count_distinct("type", "name").alias("covered"))
    return last, declared.join(covered, "archive", "left").select("archive", "declared", F.coalesce("covered", F.lit(0)).alias("covered"), "broken")


def coverage_warnings(covered: DataFrame) -> DataFrame:
    """(archive, warning) of the tables that do not give a value for all that they declare."""
    said = F.when(F.col("broken") > 0, "a resource table cannot be read").when(F.col("covered") == 0, "the resource table holds no value that can be verified").otherwise(F.format_string("the resource table is read in part (%d/%d)", "covered", "declared"))
    return covered.where("broken > 0 or covered < declared").select("archive", said.alias("warning"))

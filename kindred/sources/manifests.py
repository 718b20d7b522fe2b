"""Manifests as rows: elements and attributes of XML, written as text or in the binary form that bundles hold, and what follows
from them as Column expressions.

Binary manifests are protocol buffers (aapt2's public Resources.proto: XmlNode).  Only the wire format is read here; fields:
    XmlNode       1 element
    XmlElement    2 namespace, 3 name, 4 attributes, 5 children (XmlNode)
    XmlAttribute  1 namespace, 2 name, 3 value
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions import columns as C
from kindred.sources.parsers import COMPONENTS, FLAGS, SDKS, STABLE_NAMES, arrow_udf, parse_xml

ANDROID = "http://schemas.android.com/apk/res/android"
#: Elements in document order, each with its attributes; null if the document cannot be read.
ELEMENTS = "array<struct<tag:string,attrs:array<struct<space:string,name:string,value:string>>>>"


def wire(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(field, wire type, value) of one protocol buffer message; ValueError if it is none."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while at < len(data) and shift < 64:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7
        raise ValueError("not a protocol buffer")

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}.get(kind, -1)
        if size < 0 or at + size > len(data) or not key >> 3:
            raise ValueError("not a protocol buffer")
        yield key >> 3, kind, data[at : at + size]
        at += size


def binary_elements(data: bytes) -> list[dict] | None:
    """Of a binary manifest; null if it is none."""
    out: list[dict] = []
    waiting = [data]  # nodes, the next one last: documents may be nested deeply
    try:
        while waiting:
            element = next((v for f, t, v in wire(waiting.pop()) if (f, t) == (1, 2)), None)
            if element is None:
                continue
            fields = [(f, v) for f, t, v in wire(element) if t == 2]
            text = lambda parts, n: next((v.decode() for f, v in parts if f == n), "")
            attrs = [[(f, v) for f, t, v in wire(x) if t == 2] for n, x in fields if n == 4]
            if not text(fields, 3):
                return None
            out.append({"tag": text(fields, 3), "attrs": [{"space": text(a, 1), "name": text(a, 2), "value": text(a, 3)} for a in attrs]})
            waiting += [v for f, v in fields if f == 5][::-1]
    except ValueError:  # of wire() and of decode()
        return None
    return out or None


def _split(name: str) -> tuple[str, str]:
    space, _, short = name.rpartition("}")
    return space.lstrip("{"), short


def elements(data: bytes | str | None) -> list[dict] | None:
    root = parse_xml(data)
    if root is None:
        return binary_elements(bytes(data)) if isinstance(data, bytes | bytearray) and data else None
    return [{"tag": _split(x.tag)[1], "attrs": [dict(zip(("space", "name"), _split(k), strict=True)) | {"value": v} for k, v in x.attrib.items()]} for x in root.iter()]


@arrow_udf(ELEMENTS, once=True)
def elements_udf(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else elements(x if isinstance(x, str) else bytes(x)))


def package(data: bytes | str | None) -> str | None:
    """The package that a manifest names, without its elements being listed."""
    root = parse_xml(data)
    if root is not None:
        return root.get("package")
    found = binary_elements(bytes(data)) if isinstance(data, bytes | bytearray) and data else None
    return next((a["value"] for a in found[0]["attrs"] if (a["space"], a["name"]) == ("", "package")), None) if found else None


@arrow_udf("string", once=True)
def package_udf(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else package(x if isinstance(x, str) else bytes(x)))


def _pairs(rows: Column) -> Column:
    """Every attribute with its element's tag."""
    return F.flatten(F.transform(rows, lambda e: F.transform(e.attrs, lambda a: F.struct(e.tag.alias("tag"), a["space"].alias("space"), a["name"].alias("name"), a["value"].alias("value")))))


def features(rows: Column, content: Column) -> Column:
    """What a manifest says, without the names of its own components; its printable tokens if it cannot be read."""
    pairs, tags = _pairs(rows), F.transform(rows, lambda e: e.tag)
    rules = [
        (F.lit(True), lambda p: F.concat(p.tag, F.lit(":attr:"), p["name"])),
        (lambda p: (p["name"] == "name") & p.tag.isin(*STABLE_NAMES), lambda p: F.concat(p.tag, F.lit(":name="), p["value"])),
        (lambda p: p["name"].isin(*FLAGS), lambda p: F.concat(p.tag, F.lit(":"), p["name"], F.lit("="), F.lower(p["value"]))),
        (lambda p: p["name"].isin(*SDKS) & ~p.tag.isin(*COMPONENTS), lambda p: F.concat(p.tag, F.lit(":"), p["name"], F.lit("="), p["value"])),
    ]
    said = [F.transform(F.filter(pairs, when if callable(when) else lambda _: F.lit(True)), then) for when, then in rules]
    counted = F.transform(F.array_distinct(tags), lambda t: F.concat(F.lit("count:"), t, F.lit(":"), F.size(F.filter(tags, lambda u: u == t)).cast("string")))
    listed = F.concat(*said, counted, F.transform(tags, lambda t: F.concat(F.lit("tag:"), t)))
    return F.when(rows.isNull(), C.printable_tokens(content)).otherwise(F.array_sort(F.array_distinct(listed)))


def _named(rows: Column, *tags: str) -> Column:
    """(tag, name) of the elements with these tags that have a name."""
    return F.filter(_pairs(rows), lambda p: p.tag.isin(*tags) & (p["space"] == ANDROID) & (p["name"] == "name") & (p["value"] != ""))


def details(rows: Column, content: Column) -> Column:
    """package, components (tag and full name), permissions, actions and features."""
    package = F.get(F.filter(F.get(rows, F.lit(0)).attrs, lambda a: (a["space"] == "") & (a["name"] == "package")), F.lit(0))["value"]

    def full(name: Column) -> Column:
        """A name without a package, or one that begins with a dot, is of the manifest's package."""
        own = F.concat(package, F.when(name.startswith("."), F.lit("")).otherwise(F.lit(".")), name)
        return F.when((F.coalesce(package, F.lit("")) != "") & (name.startswith(".") | ~name.contains(".")), own).otherwise(name)

    none = F.array().cast("array<string>")
    of = lambda tag: F.coalesce(F.transform(_named(rows, tag), lambda p: p["value"]), none)
    components = F.transform(_named(rows, *COMPONENTS), lambda p: F.struct(p.tag.alias("tag"), full(p["value"]).alias("name")))
    components = F.coalesce(components, F.array().cast("array<struct<tag:string,name:string>>"))
    return F.struct(package.alias("package"), components.alias("components"), of("permission").alias("permissions"), of("action").alias("actions"), features(rows, content).alias("features"))


def owned_values(rows: Column) -> Column:
    """`tag:name=..|attribute=..` of every element but manifest and application; null if the manifest cannot be read."""
    raw = lambda a: F.concat(F.when(a["space"] != "", F.concat(F.lit("{"), a["space"], F.lit("}"))).otherwise(""), a["name"])
    order = lambda a: F.struct((a["name"] != "name").alias("later"), raw(a).alias("raw"), F.concat(a["name"], F.lit("="), a["value"]).alias("shown"))
    shown = lambda e: F.array_join(F.transform(F.array_sort(F.transform(e.attrs, order)), lambda x: x.shown), "|")
    inner = F.filter(rows, lambda e: ~e.tag.isin("manifest", "application"))
    return F.transform(inner, lambda e: F.when(F.size(e.attrs) == 0, e.tag).otherwise(F.concat(e.tag, F.lit(":"), shown(e))))

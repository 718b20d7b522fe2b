"""Methods of DEX files, read from the public file format: names and operands of every instruction of every method body."""

from __future__ import annotations

import struct
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.config import Config
from kindred.functions import columns as C
from kindred.sources import files

_KINDS = ("", "-wide", "-object", "-boolean", "-byte", "-char", "-short")
_TYPES = ("int", "long", "float", "double")
_ARITHMETIC = ("add", "sub", "mul", "div", "rem")
_BITS = ("and", "or", "xor", "shl", "shr", "ushr")


def _opcodes() -> dict[int, tuple[str, int, str]]:
    """opcode: name, length in 16-bit units, kind of the index it holds (string, type, field, method or none)."""
    table: dict[int, tuple[str, int, str]] = {}

    def put(first: int, names, size: int, index: str = ""):
        for k, name in enumerate(names):
            table[first + k] = (name, size, index)

    put(0x00, ["nop"], 1)
    for k, kind in enumerate(("", "-wide", "-object")):
        for j, (form, size) in enumerate((("", 1), ("/from16", 2), ("/16", 3))):
            put(1 + 3 * k + j, [f"move{kind}{form}"], size)
    put(0x0A, ["move-result", "move-result-wide", "move-result-object", "move-exception", "return-void", "return", "return-wide", "return-object", "const/4"], 1)
    for code, name, size, index in ((0x13, "const/16", 2, ""), (0x14, "const", 3, ""), (0x15, "const/high16", 2, ""), (0x16, "const-wide/16", 2, ""), (0x17, "const-wide/32", 3, ""), (0x18, "const-wide", 5, ""), (0x19, "const-wide/high16", 2, ""), (0x1A, "const-string", 2, "string"), (0x1B, "const-string/jumbo", 3, "wide string"), (0x1C, "const-class", 2, "type"), (0x1D, "monitor-enter", 1, ""), (0x1E, "monitor-exit", 1, ""), (0x1F, "check-cast", 2, "type"), (0x20, "instance-of", 2, "type"), (0x21, "array-length", 1, ""), (0x22, "new-instance", 2, "type"), (0x23, "new-array", 2, "type"), (0x24, "filled-new-array", 3, "type"), (0x25, "filled-new-array/range", 3, "type"), (0x26, "fill-array-data", 3, ""), (0x27, "throw", 1, ""), (0x28, "goto", 1, ""), (0x29, "goto/16", 2, ""), (0x2A, "goto/32", 3, ""), (0x2B, "packed-switch", 3, ""), (0x2C, "sparse-switch", 3, "")):
        put(code, [name], size, index)
    put(0x2D, ["cmpl-float", "cmpg-float", "cmpl-double", "cmpg-double", "cmp-long"], 2)
    put(0x32, [f"if-{c}{z}" for z in ("", "z") for c in ("eq", "ne", "lt", "ge", "gt", "le")], 2)
    for first, verb, index in ((0x44, "aget", ""), (0x4B, "aput", ""), (0x52, "iget", "field"), (0x59, "iput", "field"), (0x60, "sget", "field"), (0x67, "sput", "field")):
        put(first, [verb + k for k in _KINDS], 2, index)
    for first, form in ((0x6E, ""), (0x74, "/range")):
        put(first, [f"invoke-{k}{form}" for k in ("virtual", "super", "direct", "static", "interface")], 3, "method")
    put(0x7B, ["neg-int", "not-int", "neg-long", "not-long", "neg-float", "neg-double"], 1)
    put(0x81, [f"{a}-to-{b}" for a in _TYPES for b in _TYPES if a != b] + ["int-to-byte", "int-to-char", "int-to-short"], 1)
    binary = [f"{o}-{t}" for t in ("int", "long") for o in _ARITHMETIC + _BITS] + [f"{o}-{t}" for t in ("float", "double") for o in _ARITHMETIC]
    put(0x90, binary, 2)
    put(0xB0, [f"{b}/2addr" for b in binary], 1)
    put(0xD0, ["add-int/lit16", "rsub-int", *[f"{o}-int/lit16" for o in ("mul", "div", "rem", "and", "or", "xor")]], 2)
    put(0xD8, ["add-int/lit8", "rsub-int/lit8", *[f"{o}-int/lit8" for o in ("mul", "div", "rem", *_BITS)]], 2)
    put(0xFA, ["invoke-polymorphic", "invoke-polymorphic/range"], 4, "method")
    put(0xFC, ["invoke-custom", "invoke-custom/range"], 3)
    put(0xFE, ["const-method-handle", "const-method-type"], 2)
    return table


OPCODES = _opcodes()


class Dex:
    def __init__(self, data: bytes):
        if data[:4] != b"dex\n":
            raise ValueError("not a DEX file")
        self.data = data
        heads = struct.unpack_from("<12I", data, 56)
        (self.n_strings, self.strings_at), (self.n_types, self.types_at), (_, self.protos_at), (_, self.fields_at), (self.n_methods, self.methods_at), (self.n_classes, self.classes_at) = zip(heads[::2], heads[1::2], strict=True)

    def uleb(self, at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = self.data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    def string(self, i: int) -> str:
        _, at = self.uleb(struct.unpack_from("<I", self.data, self.strings_at + 4 * i)[0])
        raw = self.data[at : self.data.index(b"\0", at)].replace(b"\xc0\x80", b"\0")
        return raw.decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def type(self, i: int) -> str:
        return self.string(struct.unpack_from("<I", self.data, self.types_at + 4 * i)[0])

    def descriptor(self, proto: int) -> str:
        _, result, at = struct.unpack_from("<III", self.data, self.protos_at + 12 * proto)
        n = struct.unpack_from("<I", self.data, at)[0] if at else 0
        return "(" + " ".join(self.type(x) for x in struct.unpack_from(f"<{n}H", self.data, at + 4)) + ")" + self.type(result) if n else "()" + self.type(result)

    def method(self, i: int) -> tuple[str, str, str]:
        owner, proto, name = struct.unpack_from("<HHI", self.data, self.methods_at + 8 * i)
        return self.type(owner), self.string(name), self.descriptor(proto)

    def field(self, i: int) -> str:
        owner, kind, name = struct.unpack_from("<HHI", self.data, self.fields_at + 8 * i)
        return f"{self.type(owner)}->{self.string(name)} {self.type(kind)}"

    def instructions(self, at: int):
        size = struct.unpack_from("<I", self.data, at + 12)[0]
        start = at + 16
        pos = 0
        while pos < size:
            unit = struct.unpack_from("<H", self.data, start + 2 * pos)[0]
            if unit in (0x0100, 0x0200, 0x0300):  # tables of switches and arrays are no instructions
                n = struct.unpack_from("<H", self.data, start + 2 * pos + 2)[0]
                if unit == 0x0300:
                    pos += 4 + (n * struct.unpack_from("<I", self.data, start + 2 * pos + 4)[0] + 1) // 2
                else:
                    pos += 4 + 2 * n if unit == 0x0100 else 2 + 4 * n
                continue
            name, length, index = OPCODES.get(unit & 255, ("unused", 1, ""))
            output = ""
            if index:
                i = struct.unpack_from("<I" if index == "wide string" else "<H", self.data, start + 2 * pos + 2)[0]
                if index.endswith("string"):
                    output = f'"{self.string(i)}"'
                elif index == "method":
                    owner, method, proto = self.method(i)
                    output = f"{owner}->{method}{proto}"
                else:
                    output = self.type(i) if index == "type" else self.field(i)
            yield name, output
            pos += length

    def methods(self, part: int = 0, parts: int = 1):
        """(position, class, name, descriptor, instructions) of every method with a body, of one of several ranges of classes.

        The bodies of earlier ranges are counted, not read: the count is what a position starts from.
        """
        low, high, position = self.n_classes * part // parts, self.n_classes * (part + 1) // parts, 0
        for k in range(high):
            at = struct.unpack_from("<I", self.data, self.classes_at + 32 * k + 24)[0]
            if not at:
                continue
            counts = []
            for _ in range(4):
                n, at = self.uleb(at)
                counts.append(n)
            for _ in range(counts[0] + counts[1]):
                _, at = self.uleb(at)
                _, at = self.uleb(at)
            for n in counts[2:]:
                index = 0
                for _ in range(n):
                    step, at = self.uleb(at)
                    _, at = self.uleb(at)
                    code, at = self.uleb(at)
                    index += step
                    if not code or not struct.unpack_from("<I", self.data, code + 12)[0]:
                        continue
                    if k >= low:
                        yield position, *self.method(index), list(self.instructions(code))
                    position += 1


RAW = "archive string, dex_path string, position int, class_name string, method_name string, descriptor string, instructions array<struct<name:string,output:string>>, warning string"
#: Bytes of a DEX file that one task decodes.
SPLIT_BYTES = 1 << 20
ROWS = 2000

#: How a warning begins that code could not be read: scores of such a comparison are not complete.
UNREAD = "code not read: "


def _decoded(archive: str, path: str, data: bytes, part: int, parts: int):
    """Frames of RAW of one range of a file; what cannot be read is one row with a warning, of the range that meets it."""
    names, rows = [x.split()[0] for x in RAW.split(", ")], []
    try:
        for k, owner, name, proto, body in Dex(data).methods(part, parts):
            rows.append((archive, path, k, owner, name, proto, [{"name": n, "output": o} for n, o in body], None))
            if len(rows) == ROWS:
                yield pd.DataFrame(rows, columns=names)
                rows = []
    except (ValueError, struct.error, IndexError, UnicodeError) as error:
        rows.append((archive, path, -1, None, None, None, None, f"{UNREAD}{path}: {error}"))
    if rows:
        yield pd.DataFrame(rows, columns=names)


def raw_methods(contents: DataFrame) -> DataFrame:
    """One row a method body of the DEX files among contents; a file that cannot be read gives one row with a warning."""

    def run(parts):
        for part in parts:
            for archive, path, data in part.itertuples(index=False):
                yield from _decoded(archive, path, bytes(data), 0, 1)

    wanted = contents.where(F.col("path").endswith(".dex") & F.col("path").contains("/dex/")).select("archive", "path", "content")
    return wanted.mapInPandas(run, RAW)


def scan(entries: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """raw_methods() of the DEX files of safe archives, straight from the archives: entries as sources.archive lists them.

    A file is dealt out as ranges of classes, about one for every `split` bytes, each to a task that takes the file out of its archive and
    decodes its own range; so the largest file does not decide how long the scan takes.  Every range that meets what is broken says so.
    """

    def run(parts):
        for part in parts:
            for archive, path, position, k, n in part.itertuples(index=False):
                system, inner = files.located(archive)
                with system.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
                    yield from _decoded(archive, path, z.read(z.infolist()[position]), k, n)

    n = F.greatest(F.ceil(F.col("size") / split), F.lit(1)).cast("int")
    ranges = entries.where("kind = 'dex'").select("archive", "path", "position", n.alias("parts"), F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    ranges = ranges.select("archive", "path", "position", "part", "parts")
    return ranges.repartition(entries.sparkSession.sparkContext.defaultParallelism, "archive", "path", "part").mapInPandas(run, RAW)


def method_rows(raw: DataFrame, config: Config = Config()) -> DataFrame:
    """Fingerprints of raw methods of at least the configured size, third-party ones marked."""
    x = C.canonical(F.col("instructions"))
    third = ~C.starts_with_any(F.col("class_name"), config.business_prefixes) & C.starts_with_any(F.col("class_name"), config.third_party_prefixes)
    module = F.when(F.col("dex_path").contains("/"), F.split_part("dex_path", F.lit("/"), F.lit(1))).otherwise("base")
    out = raw.where("warning is null").withColumn("x", x).where(F.col("x.instruction_count") >= config.min_method_instructions)
    return out.select("archive", F.concat("class_name", F.lit("->"), "method_name", "descriptor").alias("identifier"), module.alias("module"), "dex_path", "position", "class_name", "method_name", "descriptor", "x.instruction_count", "x.canonical_hash", "x.opcode_tokens", "x.api_calls", "x.constants", "x.block_signature", third.alias("third_party"))

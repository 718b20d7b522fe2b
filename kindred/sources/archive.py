"""Archives as tables: directory entries, safety checks before anything is decompressed, and contents.

`spark.read.format("kindred_archive")` is a data source.  Its partitions are byte ranges of archives: a task reads the directory at an
archive's end by ranged reads, and then those entries alone that begin in its range, so an archive of any size is read
by many tasks and never held whole.  Filters on kind, path and size reach it: an entry that they drop is not decompressed.
"""

from __future__ import annotations

import zipfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from kindred import schemas
from kindred.config import ArchiveLimits
from kindred.functions import columns as C
from kindred.sources import files, parsers


BATCH_BYTES = 8 << 20
#: Bytes of an archive that one task reads.
SPLIT_BYTES = 32 << 20
#: Stands for an archive that is not opened: position -1, its own size.
UNREAD = -1

#: Entries as schemas.ENTRIES has them, with their kind (null: of no use to any table) and, if asked for, content.
ENTRIES = schemas.ENTRIES + ", kind string"


def kind(name: str) -> str | None:
    """What an entry is to the tables; None if no table uses it."""
    s = name.split("/")
    second = s[1] if len(s) > 1 else ""
    if name.endswith("/") or not name:
        return None
    if name.endswith(".dex") and "/dex/" in name:
        return "dex"
    if name.endswith("/manifest/AndroidManifest.xml"):
        return "manifest"
    if len(s) == 2 and second == "resources.pb":
        return "table"
    if len(s) >= 3 and second in ("res", "assets"):
        return "resource" if second == "res" else "asset"
    if len(s) >= 4 and second == "lib" and name.endswith(".so"):
        return "native"
    return "build" if name == "BundleConfig.pb" or name.startswith(("BUNDLE-METADATA/", "META-INF/")) else None


@dataclass
class Range(InputPartition):
    """Of an archive the entries whose headers begin at low up to before high."""

    archive: str
    size: int
    low: int
    high: int


#: Filters that a scan applies itself: of a value, and with the filter.
TESTS = {
    EqualTo: lambda v, f: v == f.value,
    In: lambda v, f: v in f.value,
    IsNotNull: lambda v, f: v is not None,
    StringStartsWith: lambda v, f: v.startswith(f.value),
    StringEndsWith: lambda v, f: v.endswith(f.value),
    StringContains: lambda v, f: f.value in v,
    LessThan: lambda v, f: v < f.value,
    LessThanOrEqual: lambda v, f: v <= f.value,
    GreaterThan: lambda v, f: v > f.value,
    GreaterThanOrEqual: lambda v, f: v >= f.value,
}


class ArchiveReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.skip = options["path"], set(filter(None, options.get("skip", "").split("\n")))
        self.most, self.split = int(options.get("maxInputSize", ArchiveLimits().max_input_size)), int(options.get("splitBytes", SPLIT_BYTES))
        self.names, self.filters = schema.names, []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if type(f) in TESTS and f.attribute[0] in ("kind", "path", "size", "compressed_size") and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        out = []
        for archive, size in files.listed(self.path):
            if archive in self.skip:
                continue
            whole = "content" not in self.names or size > self.most
            cuts = [0] if whole else range(0, max(size, 1), self.split)
            out += [Range(archive, size, low, size if whole else low + self.split) for low in cuts]
        return out or [Range("", -1, 0, 0)]

    def _kept(self, row: dict) -> bool:
        """As SQL has it: a filter on a null does not hold."""
        return all((v := row[f.attribute[0]]) is not None and TESTS[type(f)](v, f) for f in self.filters)

    def read(self, part: Range):
        if part.size < 0:
            return
        unread = {"archive": part.archive, "path": None, "size": part.size, "compressed_size": part.size, "crc": 0, "mode": 0, "position": UNREAD, "kind": None, "content": None}
        rows, held = [], 0
        system, inner = files.located(part.archive)
        with system.open_input_file(inner) as f:
            try:
                z = zipfile.ZipFile(f) if part.size <= self.most else None
            except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter where a file is shorter than any directory
                z = None
            if z is None:
                rows = [unread] if part.low == 0 and self._kept(unread) else []
            for k, i in enumerate(z.infolist() if z else ()):
                if not part.low <= i.header_offset < max(part.high, 1):
                    continue
                name = i.filename.replace("\\", "/")
                row = {"archive": part.archive, "path": name, "size": i.file_size, "compressed_size": i.compress_size, "crc": i.CRC, "mode": i.external_attr >> 16, "position": k, "kind": kind(name)}
                if not self._kept(row):
                    continue
                if "content" in self.names:
                    row["content"] = b"" if name.endswith("/") else z.read(i)
                    held += i.file_size
                rows.append(row)
                if held > BATCH_BYTES or len(rows) >= 10_000:  # small entries go together, memory stays bounded
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        types = {"size": pa.int64(), "compressed_size": pa.int64(), "crc": pa.int64(), "mode": pa.int32(), "position": pa.int32(), "content": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in self.names], self.names)


class ArchiveSource(DataSource):
    """format("kindred_archive"): options path (a file, folder or glob), splitBytes, maxInputSize, skip (archives, a line each).
    Give a schema without content to read directories only."""

    @classmethod
    def name(cls) -> str:
        return "kindred_archive"

    def schema(self) -> str:
        return ENTRIES + ", content binary"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options, schema)


def scan(spark: SparkSession, path: str, limits: ArchiveLimits = ArchiveLimits(), *, content: bool, skip: list[str] = (), split: int | None = None) -> DataFrame:
    """Entries of every archive under path; content: what they hold as well."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format(ArchiveSource.name()).options(path=path, splitBytes=split or SPLIT_BYTES, maxInputSize=limits.max_input_size, skip="\n".join(skip))
    return reader.schema(ENTRIES + (", content binary" if content else "")).load()


def entries(spark: SparkSession, path: str, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """Directory entries of every archive under path (a file, folder or glob); nothing is decompressed.

    An archive over the size limit, or one that is no archive, is a single row without a path, at position -1.
    """
    return scan(spark, path, limits, content=False)


def violations(entries: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """entries with the rule that each breaks, if any, and whether its path occurs twice in its archive."""
    s = F.split("path", "/")
    unsafe = F.col("path").startswith("/") | F.array_contains(s, "..") | (F.col("path") == "")
    link = F.col("mode").bitwiseAND(F.lit(0o170000)) == 0o120000
    ratio = F.col("size") / F.col("compressed_size")
    rule = (
        F.when(unsafe, "unsafe path")
        .when(link, "symbolic link")
        .when(F.col("size") > limits.max_entry_size, "entry too large")
        .when((F.col("size") > 0) & (F.col("compressed_size") == 0), "invalid compressed size")
        .when((F.col("compressed_size") > 0) & (ratio > limits.max_compression_ratio), "unsafe ratio")
    )
    name = F.rtrim("path", F.lit("/"))
    return entries.select("*", rule.alias("violation"), (F.count("*").over(Window.partitionBy("archive", name)) > 1).alias("duplicate"))


def check(entries: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """(archive, problem) for every archive that must not be read: the first broken rule of each."""
    unread = entries.where(F.col("position") == UNREAD)
    unread = unread.select("archive", F.when(F.col("size") > limits.max_input_size, "input too large").otherwise("not an archive").alias("problem"))
    v = violations(entries.where(F.col("position") != UNREAD), limits).where("path <> ''")
    per = v.groupBy("archive").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.max("duplicate").alias("twice"), F.min_by("violation", "position").alias("first"), F.min(F.struct(F.col("violation").isNull(), "position", "violation")).alias("worst"))
    problem = F.when(F.col("n") > limits.max_entries, "too many entries").when(F.col("worst.violation").isNotNull(), F.col("worst.violation")).when(F.col("twice"), "duplicate entry").when(F.col("total") > limits.max_uncompressed_size, "uncompressed size exceeds the limit")
    return per.select("archive", problem.alias("problem")).where("problem is not null").unionByName(unread)


def inventory(entries: DataFrame) -> DataFrame:
    """Per archive: modules (with a manifest folder) and counts by kind."""
    s = F.split(F.rtrim("path", F.lit("/")), "/")
    n, second = F.size(s), F.get(s, F.lit(1))
    kinds = {
        "dex": (n >= 3) & (second == "dex") & F.col("path").endswith(".dex"),
        "native": (n >= 4) & (second == "lib") & F.col("path").endswith(".so"),
        "assets": (n >= 3) & (second == "assets"),
        "resources": (n >= 3) & (second == "res"),
        "manifests": (n >= 3) & (second == "manifest") & (F.element_at(s, -1) == "AndroidManifest.xml"),
    }
    modules = F.array_sort(F.collect_set(F.when((n >= 3) & (second == "manifest"), F.get(s, F.lit(0)))))
    return entries.where("path <> ''").groupBy("archive").agg(F.count("*").alias("entries"), *[F.count_if(v).alias(k) for k, v in kinds.items()], modules.alias("modules"))


def contents(spark: SparkSession, path: str, limits: ArchiveLimits = ArchiveLimits(), *, pruned: bool = True, split: int | None = None) -> DataFrame:
    """(archive, path, content) of the entries of safe archives; pruned: only of kinds that any table uses."""
    # a row a broken archive goes to the driver, which lists all archives anyway
    bad = [r.archive for r in check(entries(spark, path, limits), limits).select("archive").collect()]
    held = scan(spark, path, limits, content=True, skip=bad, split=split)
    return (held.where("kind is not null") if pruned else held.where("path is not null and not endswith(path, '/')")).select("archive", "path", "content")


def file_rows(contents: DataFrame, *, asset_semantic: str = "reference") -> DataFrame:
    """Fingerprints of categorised entries: path, module, category, size, sha256, semantic_hash, features."""
    c = contents.withColumn("category", C.category(F.col("path")))
    special = F.col("path").endswith("/manifest/AndroidManifest.xml") | (F.col("path").endswith(".dex") & F.col("path").contains("/dex/"))
    c = c.where(F.col("category").isNotNull() & ~special)
    c = c.withColumn("symbols", parsers.elf_features_udf(F.when(F.col("category") == "native", F.col("content"))))
    tokens = C.printable_tokens(F.col("content"))
    chunks = C.chunk_digests(F.col("content"))
    elf = F.hex(F.substr(F.col("content"), F.lit(1), F.lit(4))) == "7F454C46"
    symbols = F.coalesce(F.col("symbols"), F.array().cast("array<string>"))
    native = F.array_sort(F.array_distinct(F.concat(F.array(F.when(elf, "elf").otherwise("binary")), F.filter(tokens, lambda t: t.contains(".so")), F.transform(chunks, lambda x: F.concat(F.lit("chunk:"), x)), symbols)))
    features = F.when(F.col("category") == "asset", chunks).when(F.col("category") == "native", native).when(F.col("category") == "build", F.slice(tokens, 1, 200)).otherwise(tokens)
    semantic = C.semantic_hash(F.col("features"), F.col("content"))
    if asset_semantic == "content":
        semantic = F.when(F.col("category") == "asset", F.sha2(F.array_join("features", "\n").cast("binary"), 256)).otherwise(semantic)
    c = c.withColumn("features", features)
    return c.select("archive", "path", C.module(F.col("path")).alias("module"), "category", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), semantic.alias("semantic_hash"), "features")


#: Where a build puts the mapping of its names.
MAPPING = "BUNDLE-METADATA/com.android.tools.build.obfuscation/proguard.map"


def embedded_mapping(contents: DataFrame) -> DataFrame:
    """(output, original, entry, sha256) of the mapping in an archive: of the usual entry, else of the first other one, by
    name, that has any line to use."""
    named = F.col("path").startswith("BUNDLE-METADATA/") & (F.col("path").endswith("proguard.map") | F.col("path").endswith("mapping.txt"))
    held = contents.where(named).select("path", F.sha2("content", 256).alias("sha256"), "content")
    rows = parsers.r8_mapping(parsers.mapping_lines(held, ["path"]), key="path")
    first = rows.agg(F.min(F.struct(F.col("path") != MAPPING, "path")).alias("x")).select("x.path")
    return rows.join(F.broadcast(first), "path").join(held.select("path", "sha256"), "path").select("output", "original", F.col("path").alias("entry"), "sha256")

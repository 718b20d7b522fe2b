"""Token ids of documents, and files of them with a fixed number of bits per id.

File format (little-endian), one file a shard:
    16 bytes  magic `KINDRED-BITS-01\\n`
    blocks    BLOCK ids each, every id in `bits` bits, lowest bit first; a block starts on a byte
    documents n_docs x (doc_id int64, first id in the shard int64); the first n_null have no doc_id (0 is written)
    offsets   n_blocks x byte offset uint64
    56 bytes  bits, BLOCK, n_ids, n_blocks, n_docs, n_null, offset of the documents: seven uint64
Any id is found from the offset of its block; a block unpacks with a few numpy calls.

Documents are written in ascending doc_id order, those without one first: Spark deals them by ranges of doc_id (ties by
a hash of the text), every task writes its shards itself into the shared folder, under names of its own attempt, and
only what successful tasks report is read.  A shard holds at most SHARD ids or one document.  Where a shard starts in the
corpus follows from sums over the tasks' reports; no list of shards is on the driver.

Cases: null text is empty; an empty text has the end id alone; a very long text is encoded whole; repeated rows are
documents of their own; an empty table gives an empty result; other columns are ignored; an id that does not fit the bits
of the vocabulary raises an error, nothing is cut off.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.bulk import Bulk, bulk
from kindred.llm.common import fresh_path, lean, materialise, partitions, slices, text_bytes

BLOCK = 4096
SHARD = 4 << 20
MAGIC = b"KINDRED-BITS-01\n"
#: Words whose ids a worker remembers: some 30 bytes each.
KEEP = 600_000
_GAP = re.compile(r"(?<=\S) (?=\S)")
_ODD = "\x1c\x1d\x1e\x1f"
_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


#: A run of these after letters and before white space is split off as one.
_POINTS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


def _byte_letters() -> dict[int, str]:
    """Byte-level files write every byte as a printable character: itself, or one from 256 on, in order; blanks stay."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out | {32: " "}


_LETTERS = _byte_letters()


class Encoder:
    """The ids of a tokenizers file, without special tokens added.  Texts are split where the file's own splitting
    always cuts, before a lone blank between two other characters, and each distinct part is encoded once.

    New words of letters only are encoded together by the library's model of the same file without its normalizer and
    splitter, which would leave them as they are; all else goes through the whole file.
    """

    def __init__(self, path: str, spaced: bool, keep: int = 20_000):
        """spaced: whether a blank belongs to the word that follows it; else blanks vanish and letters are lower-cased."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.keep = Tokenizer.from_file(path), spaced, keep
        plain = json.loads(self.tokenizer.to_str())
        plain |= {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.recent: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        self.mark, self.mark_id = min((x.content, i) for i, x in self.tokenizer.get_added_tokens_decoder().items())
        size = self.tokenizer.get_vocab_size()
        opens, closes = np.zeros(size, bool), np.zeros(size, bool)
        for x, i in self.tokenizer.get_vocab().items():
            opens[i], closes[i] = x.startswith("\u0120"), x.endswith("</w>")
        self.opens, self.closes = opens, closes
        self.line = self._ids(["\n"])[0]
        self.points: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes] | None:
        """Words of letters only, in one call: told apart by the tokens that open (with a blank) or close a word."""
        text = " ".join(words)
        if not self.spaced and not text.isascii() and ("\u03a3" in text or "\u0130" in text or not unicodedata.is_normalized("NFC", text)):
            return None  # lower case that depends on the word, or letters that the normalizer composes
        text = (text if self.spaced else text.lower()).encode().decode("latin-1").translate(_LETTERS)
        if self.spaced:
            text = "\u0120" + text.replace(" ", " \u0120")
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.opens[ids]) if self.spaced else np.flatnonzero(self.closes[ids]) + 1
        if len(cuts) != len(words):
            return None
        data = ids.tobytes()
        ends = [*cuts[1:].tolist(), len(ids)] if self.spaced else cuts.tolist()
        starts = cuts.tolist() if self.spaced else [0, *cuts[:-1].tolist()]
        return [data[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]

    def _marked(self, parts: list[str]) -> list[bytes]:
        """Any parts in one call, with a special token's string between them, unless a part may hold such a string."""
        if any("<|" in x for x in parts):
            return self._ids(parts)
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(parts)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.mark_id)
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *(cuts + 1)], [*cuts, len(ids)], strict=True)]

    def _learn(self, known: dict[str, bytes], parts: list[str], lead: str) -> dict[str, bytes]:
        """The ids of parts that are not in known, and of the words in them."""
        pointed, other = [], []
        words = {x for x in parts if x.isalpha()} if lead or not self.spaced else set()
        for x in parts if len(words) < len(parts) else ():
            if x not in words:
                stem = x.rstrip(_POINTS)
                if (lead or not self.spaced) and stem.isalpha():
                    pointed.append((x, stem, x[len(stem) :]))
                else:
                    other.append(x)
        words.update({stem for _, stem, _ in pointed}.difference(known))
        tails = list({tail for *_, tail in pointed}.difference(self.points))
        if tails:
            if len(self.points) > self.keep // 10:
                self.points.clear()
                tails = list({tail for *_, tail in pointed})
            self.points.update(zip(tails, self._ids(tails), strict=True))
        new: dict[str, bytes] = {}
        if words:
            listed = list(words)
            found = self._words(listed)
            new.update(zip(listed, found if found is not None else self._marked([lead + x for x in listed]), strict=True))
        for x, stem, tail in pointed:
            new[x] = (new.get(stem) or known[stem]) + self.points[tail]
        if other:
            new.update(zip(other, self._marked([lead + x for x in other]), strict=True))
        return new

    def _look(self, known: dict[str, bytes], parts: set[str], lead: str) -> dict[str, bytes]:
        """The ids of all parts, in a dictionary of just these: small, and so quick to ask for every word of the texts.

        What is asked for again before the recent parts are forgotten is kept for long.
        """
        recent = self.recent[lead]
        local = dict(zip(parts, map(known.get, parts), strict=True))
        missing = [x for x, v in local.items() if v is None]
        again = {x: recent[x] for x in missing if x in recent}
        if again:
            local.update(again)
            known.update(again)
            missing = [x for x in missing if x not in again]
        if missing:
            new = self._learn(known, missing, lead)
            local.update(new)
            if len(recent) > self.keep:
                recent.clear()
            recent.update(new)
        if len(known) > self.keep:  # the parts learnt first are the common ones
            some = list(itertools.islice(known.items(), self.keep // 2))
            known.clear()
            known.update(some)
        return local

    def _parts(self, text: str) -> list[str]:
        """A part after the first follows a blank, or begins with the line feed that it follows."""
        if not self.spaced:
            return _GAP.split(text) if any(c in text for c in _ODD) else text.split()
        if text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in ("  ", " \n", "\n ", "\n\n", *_SPACES)):
            return text.replace("\n", " \n").split(" ")
        return _GAP.split(text)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = [self._parts(x) if x else [] for x in texts]
        if not self.spaced:
            ids = self._look(self.first, set(itertools.chain.from_iterable(split)), "").__getitem__
            return [np.frombuffer(b"".join(map(ids, x)), "<u4") for x in split]
        rest = set(itertools.chain.from_iterable(x[1:] for x in split))
        lines = {x for x in rest if x[:1] == "\n" and not x[1:2].isspace()}
        first = self._look(self.first, {x[0] for x in split if x} | {x[1:] for x in lines}, "")
        later = self._look(self.later, rest - lines, " ")
        later.update((x, self.line + first[x[1:]]) for x in lines)
        ids = later.__getitem__
        return [np.frombuffer((first[x[0]] if x else b"") + b"".join(map(ids, x[1:])), "<u4") for x in split]


def encoded(column: pa.Array, encode: Bulk, end: int, limit: int = 1 << 21):
    """The ids of every text of a column, the end id last; texts go to the encoder by about two MB."""
    raw, offsets = text_bytes(column)
    for i, j in slices(offsets, limit):
        for ids in encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
            yield np.append(ids, np.uint32(end)).astype("<u4")


def vocabulary_size(path: str, end: int) -> int:
    """One more than the largest id that a tokenizers file, or the end id, can give."""
    from tokenizers import Tokenizer

    return 1 + max(end, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits < 32 and len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(flat.ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    flat = np.zeros((n, 32), np.uint8)
    flat[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return np.packbits(flat, axis=1, bitorder="little").view("<u4").ravel()


def shard_bytes(doc_ids: list[int | None], ids: list[np.ndarray], bits: int) -> bytes:
    flat = np.concatenate(ids)
    starts = np.cumsum([0, *map(len, ids)])[:-1]
    out, offsets = [MAGIC], []
    at = len(MAGIC)
    for i in range(0, len(flat), BLOCK):
        offsets.append(at)
        out.append(pack(flat[i : i + BLOCK], bits))
        at += len(out[-1])
    known = [x for x in doc_ids if x is not None]
    nulls = len(doc_ids) - len(known)
    docs = np.stack([np.array([0] * nulls + known, "<i8"), starts.astype("<i8")], 1).tobytes()
    tail = np.array([bits, BLOCK, len(flat), len(offsets), len(ids), nulls, at], "<u8")
    return b"".join([*out, docs, np.array(offsets, "<u8").tobytes(), tail.tobytes()])


class Shard:
    """Random access to the ids of one file."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of token ids")
        self.data = memoryview(data)
        self.bits, self.block, self.n_ids, n_blocks, n_docs, self.n_null, at = (int(x) for x in np.frombuffer(data[-56:], "<u8"))
        docs = np.frombuffer(self.data[at : at + 16 * n_docs], "<i8").reshape(-1, 2)
        self.doc_ids, self.starts = docs[:, 0], docs[:, 1]
        self.offsets = np.frombuffer(self.data[at + 16 * n_docs : at + 16 * n_docs + 8 * n_blocks], "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, "<u4")
        a, b = start // self.block, (stop - 1) // self.block + 1
        parts = []
        for k in range(a, b):
            n = min(self.block, self.n_ids - k * self.block)
            parts.append(unpack(self.data[self.offsets[k] : self.offsets[k] + (n * self.bits + 7) // 8], n, self.bits))
        return np.concatenate(parts)[start - a * self.block : stop - a * self.block]


def write(documents: DataFrame, tokenizer: str, *, end: int, spaced: bool, folder: str | None = None, keep: int = KEEP) -> DataFrame:
    """Writes the files; returns (shard path, first id of the shard in the corpus, its number of ids)."""
    spark = documents.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    bits = max(1, (vocabulary_size(tokenizer, end) - 1).bit_length())

    def run(batches):
        from pyarrow.fs import FileSystem

        encode = bulk(tokenizer, spaced, keep)
        fs, place = FileSystem.from_uri(folder)
        fs.create_dir(place)
        part, number = TaskContext.get().partitionId(), 0
        docs: list[int] = []
        ids: list[np.ndarray] = []

        def flush():
            name = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.bits"
            with fs.open_output_stream(f"{place}/{name}") as out:
                out.write(shard_bytes(docs, ids, bits))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (number, pa.int32()), (f"{folder}/{name}", pa.string()), (sum(map(len, ids)), pa.int64()))], ["part", "number", "path", "n_ids"])

        size = 0
        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), encoded(batch.column(1), encode, end), strict=True):
                if size and size + len(x) > SHARD:
                    yield flush()
                    docs, ids, size, number = [], [], 0, number + 1
                docs.append(doc_id)
                ids.append(x)
                size += len(x)
        if docs:
            yield flush()

    own = documents.select("doc_id", "text", F.xxhash64("text").alias("tie"))  # many rows may have one doc_id, or none
    dealt = own.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    written = materialise(dealt.mapInArrow(lean(run), "part int, number int, path string, n_ids long"), "shards")
    # a row for each task, then the shards of one task: neither sum runs over all shards
    parts = written.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    return written.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, "part").select("path", (F.col("base") + F.col("inside")).alias("start"), "n_ids")


def read(shards: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        from pyarrow.fs import FileSystem

        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = FileSystem.from_uri(path)
                with fs.open_input_stream(place) as file:
                    shard = Shard(file.read())
                ids = shard.ids(0, shard.n_ids)
                stops = np.append(shard.starts[1:], shard.n_ids)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(shard.starts, stops, strict=True)]
                null = np.arange(len(stops)) < shard.n_null
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, mask=null), pa.array(shard.starts + first), pa.array(stops - shard.starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = shards.select("path", "start").repartition(partitions(shards.sparkSession))
    return files.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")

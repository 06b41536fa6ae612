"""Token ids as flat files of unsigned integers with 64-bit document offsets, memory-mapped.

A folder of token files holds, for each partition k of a table that is dealt by range of the document id,

* `kind=ids/part-k-*`      the ids of its documents, one after another, as little-endian unsigned integers of 16 bits
                           (of 32 where an id needs them), each document closed by the end id;
* `kind=offsets/part-k-*`  one unsigned 64-bit integer a document: where it starts, counted in ids of this file;
* `kind=docs/part-k-*`     DOCUMENT, one record a document: its id and whether it has one;

and `manifest.json`, which names the files in order with their bases.  The base of a file is the number of ids in all
files before it, a prefix sum of file lengths, so a document starts at base + offset.

Spark's own text writer commits the files, so that lost tasks and executors leave none behind and any store that Spark
writes to will do.  It ends each record with one separator, here the last byte of the record itself: a document ends
with the end id, whose top byte is fixed, and offsets and records end with a zero byte.  The files hold nothing else.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import lean, shared_dir, table, utf8

#: One record of a `docs` file; `there` is 0 for a document without an id, `end` is the separator.
DOCUMENT = np.dtype([("id", "<i8"), ("there", "u1"), ("end", "u1")])
#: Bytes of ids that a task gathers before it hands them to the writer.
CHUNK_BYTES = 1 << 20
#: Words of at most this many bytes are remembered by a worker, and at most twice this many of them.
REMEMBERED_BYTES, REMEMBERED_WORDS = 32, 250_000

#: The normalizer and the split pattern of tokenizers that treat each word between white space apart.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Small letters of ASCII and Latin-1 in UTF-8: neither normal form nor lower case changes them.
LETTERS = re.compile(rb"(?:[a-z]|\xC3[\x9F-\xB6\xB8-\xBF])+")
#: The characters that stand for bytes in byte-level vocabularies: those that don't print are moved beyond 255.
BYTE_LEVEL = {b: 256 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


def words_apart(description: dict) -> bool:
    """Whether a tokenizer (its JSON) is known to encode a text as its words between white space, one after another."""
    split = (description.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        (description.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and split[0].get("pattern") == {"Regex": SPLIT}
        and (split[0].get("behavior"), split[0].get("invert")) == ("Removed", True)
        and [x.get("type") for x in split[1:]] == ["ByteLevel"]
        and not split[1].get("add_prefix_space")
        and not any(x.get("normalized") or x.get("single_word") or x.get("lstrip") or x.get("rstrip") or any(map(str.isspace, x["content"])) for x in description.get("added_tokens") or [])
    )


class WordIds(dict):
    """The ids of each lower-case word as bytes, filled by the tokenizer as words come, of a bounded size: when it is full,
    its words are forgotten unless they come again before it is full once more.

    Words of small Latin letters are pieces of their own for such a tokenizer, and so is one mark after them."""

    def __init__(self, tokenizer, kind: str) -> None:
        super().__init__()
        self.tokenizer, self.before = tokenizer, {}
        self.packed = [np.array([i], kind).tobytes() for i in range(max(tokenizer.get_vocab(with_added_tokens=True).values(), default=0) + 1)]

    def _packed(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.packed[i] for i in ids])

    def __missing__(self, word: bytes) -> bytes:
        found = self.before.get(word)
        if found is None:
            if LETTERS.fullmatch(word):
                found = self._packed(t.id for t in self.tokenizer.model.tokenize(word.decode("latin-1").translate(BYTE_LEVEL)))
            elif word[-1:] in b".,;:!?" and LETTERS.fullmatch(word, 0, len(word) - 1):
                found = self[word[:-1]] + self[word[-1:]]
            else:
                found = self._packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        if len(word) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = found
        return found


class Encoder:
    """The ids of whole texts, by the tokenizers library, as bytes of little-endian unsigned integers of `kind`.

    A tokenizer that treats words apart is asked once for each word that a worker meets; any other encodes whole texts."""

    def __init__(self, path: str, kind: str) -> None:
        self.tokenizer, self.kind = loaded(path), kind
        described = json.loads(self.tokenizer.to_str())
        self.added = [t["content"].encode() for t in described.get("added_tokens") or []]
        self.words = WordIds(self.tokenizer, self.kind) if words_apart(described) else None

    def __call__(self, raw: bytes | None) -> bytes:
        if not raw:
            return b""
        if self.words is None:
            return np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, self.kind).tobytes()
        if any(t in raw for t in self.added):  # added tokens are found in the text as it is written
            return np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(map(self.words.__getitem__, raw.lower().split()))


def loaded(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are dealt by Spark
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """Built once for each worker process; the last one is kept."""
    if (path, kind) not in _encoders:
        _encoders.clear()
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def largest_id(path: str) -> int:
    """The largest id of a tokenizer, added tokens included."""
    return max(loaded(path).get_vocab(with_added_tokens=True).values(), default=0)


def unsigned(largest: int, end_id: int = 0) -> str:
    """The smallest unsigned type of the files that holds an id and in which the end id's top byte is 0."""
    if not 0 <= max(largest, end_id) < 1 << 24:
        raise ValueError("ids have to be below 2^24")
    return "<u2" if largest < 1 << 16 and end_id < 1 << 8 else "<u4"


def _cut(record: bytes) -> bytes:
    """A record without its last byte, which the writer puts back."""
    if record[-1]:
        raise ValueError("a record has to end with a zero byte")
    return record[:-1]


def _records(tokenizer: str, kind: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    closing = np.array([end_id], kind).tobytes()

    def out(of: str, record: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array([of], pa.string()), "record": pa.array([_cut(record)], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, kind)
        lengths, docs, held, n = [], [], [], 0
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids = encode(raw) + closing
                docs.append((0 if key is None else key, key is not None, 0))
                lengths.append(len(ids) // len(closing))
                held.append(ids)
                n += len(ids)
                if n >= CHUNK_BYTES:
                    yield out("ids", b"".join(held))
                    held, n = [], 0
        if held:
            yield out("ids", b"".join(held))
        if lengths:
            yield out("offsets", np.cumsum([0, *lengths[:-1]], dtype="<u8").tobytes())
            yield out("docs", np.array(docs, DOCUMENT).tobytes())

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", parts: int | None = None) -> TokenFiles:
    """Encodes every whole text, appends end_id, and writes the ids in ascending order of the key under `path`.

    Null keys come first; rows of one key come by a hash of their text, and rows alike in both in any order, as they are
    alike in the files too.  Rows are dealt by range of key, hash and place in the scan, so that a key of very many rows
    goes to many files.  Null and empty texts are the end id alone; texts of any length are encoded whole.  An empty
    table gives a folder without parts.  Columns other than the key and the text are not read, so their names can't
    clash.  A task holds 18 bytes for each document of its partition until it ends.
    """
    spark = docs.sparkSession
    lean(spark)
    kind = unsigned(largest_id(tokenizer), end_id)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    by = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("scan")]
    dealt = rows.withColumn("scan", F.monotonically_increasing_id()).repartitionByRange(*([] if parts is None else [parts]), *by).sortWithinPartitions(*by)
    records = dealt.select("id", "text").mapInArrow(_records(tokenizer, kind, end_id), "kind string, record binary")
    setting = "spark.sql.maxConcurrentOutputFileWriters"  # a writer for each kind: records keep their order, without a sort
    before = spark.conf.get(setting)
    spark.conf.set(setting, "3")
    try:
        records.select("kind", F.col("record").cast("string")).write.partitionBy("kind").option("lineSep", "\0").text(path)
    finally:
        spark.conf.set(setting, before)
    return TokenFiles.sealed(spark, path, kind, end_id)


@dataclass(frozen=True)
class Part:
    """Three files (names inside the folder), the ids before them, and their ids and documents."""

    ids: str
    offsets: str
    docs: str
    base: int
    n_ids: int
    n_docs: int


class TokenFiles:
    """A folder of token files.  Their names and bases are held by the driver, one entry a partition."""

    def __init__(self, spark: SparkSession, path: str, kind: str, end_id: int, parts: list[Part]) -> None:
        fs, root = _store(spark, path)
        self.spark, self.path, self.kind, self.end_id, self.parts = spark, fs.makeQualified(root).toString(), kind, end_id, parts
        self.bases = [p.base for p in parts]

    @classmethod
    def sealed(cls, spark: SparkSession, path: str, kind: str, end_id: int) -> TokenFiles:
        """Names the files in order with their bases, prefix sums of their lengths, and writes the manifest."""
        fs, _ = _store(spark, path)
        found: dict[str, dict[str, tuple[str, int]]] = {}
        for of in ("ids", "offsets", "docs"):
            folder = _path(spark, f"{path}/kind={of}")
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                name = status.getPath().getName()
                if name.startswith("part-"):
                    found.setdefault(name.split("-")[1], {})[of] = (f"kind={of}/{name}", status.getLen())
        parts, base, width = [], 0, np.dtype(kind).itemsize
        for _, files in sorted(found.items(), key=lambda x: int(x[0])):
            n_ids, n_docs = files["ids"][1] // width, files["offsets"][1] // 8
            if files["ids"][1] % width or files["docs"][1] != n_docs * DOCUMENT.itemsize:
                raise ValueError(f"the files of a part do not fit each other: {files}")
            parts.append(Part(files["ids"][0], files["offsets"][0], files["docs"][0], base, n_ids, n_docs))
            base += n_ids
        text = json.dumps({"kind": kind, "end_id": end_id, "parts": [vars(p) for p in parts]})
        stream = fs.create(_path(spark, f"{path}/manifest.json"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return cls(spark, path, kind, end_id, parts)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TokenFiles:
        found = json.loads(spark.read.option("wholetext", "true").text(f"{path}/manifest.json").first()[0])
        return cls(spark, path, found["kind"], found["end_id"], [Part(**p) for p in found["parts"]])

    @property
    def n_tokens(self) -> int:
        return self.parts[-1].base + self.parts[-1].n_ids if self.parts else 0

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start up to stop of all, across files; only the pages that hold them are read."""
        out = []
        for at in range(max(bisect_right(self.bases, start) - 1, 0), len(self.parts)):
            part = self.parts[at]
            if part.base >= stop:
                break
            out.append(np.array(mapped(local(self.path), part.ids, self.kind)[max(start - part.base, 0) : stop - part.base]))
        return np.concatenate(out) if out else np.empty(0, self.kind)

    def documents(self, ids: bool = False, mmap: bool | None = None) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 and, if asked, ids of every document, read back from the files.

        start counts all ids before it; the checksum and `ids` are of little-endian unsigned 32-bit integers.  A task
        maps the files of a part where all machines mount the folder (mmap, by default for `file:` paths), and gets
        them from Spark's reader of binary files elsewhere."""
        schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else "")
        kind, spark = self.kind, self.spark
        if not self.parts:
            return spark.createDataFrame([], schema)
        if local(self.path) is not None if mmap is None else mmap:
            root = local(self.path)

            def from_disk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for base, *names in zip(*batch.to_pydict().values(), strict=True):
                        yield from _read(base, *(mapped(root, n, k) for n, k in zip(names, (kind, "<u8", DOCUMENT), strict=True)), ids)

            names = spark.createDataFrame([(p.base, p.ids, p.offsets, p.docs) for p in self.parts], "base long, ids string, offsets string, docs string")
            return names.repartition(len(self.parts)).mapInArrow(from_disk, schema)

        def from_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for base, *raw in zip(*batch.to_pydict().values(), strict=True):
                    yield from _read(base, *(np.frombuffer(r, k) for r, k in zip(raw, (kind, "<u8", DOCUMENT), strict=True)), ids)

        lean(spark)
        files = spark.read.format("binaryFile").load([f"{self.path}/kind={of}" for of in ("ids", "offsets", "docs")])
        named = files.select(F.regexp_extract("path", r"kind=(\w+)/part-(\d+)", 1).alias("of"), F.regexp_extract("path", r"kind=(\w+)/part-(\d+)", 2).cast("long").alias("part"), "content")
        bases = spark.createDataFrame([(int(p.ids.split("/part-")[1].split("-")[0]), p.base) for p in self.parts], "part long, base long")
        of = {k: named.where(F.col("of") == k).select("part", F.col("content").alias(k)) for k in ("ids", "offsets", "docs")}
        whole = bases.join(of["ids"], "part").join(of["offsets"], "part").join(of["docs"], "part")
        return whole.select("base", "ids", "offsets", "docs").mapInArrow(from_rows, schema)


def _read(base: int, ids: np.ndarray, offsets: np.ndarray, docs: np.ndarray, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Documents of one part, some thousand at a time."""
    step = 16 if with_ids else 4096
    for first in range(0, len(offsets), step):
        starts = offsets[first : first + step].astype(np.int64)
        last = len(ids) if first + step >= len(offsets) else int(offsets[first + step])
        ends = np.append(starts[1:], last)
        raw = [ids[a:z].astype("<u4").tobytes() for a, z in zip(starts, ends, strict=True)] if with_ids else None
        sums = [zlib.crc32(r) for r in raw] if raw is not None else [zlib.crc32(ids[a:z].astype("<u4")) for a, z in zip(starts, ends, strict=True)]
        own = docs[first : first + step]
        out = {"doc_id": pa.array(own["id"].astype(np.int64), mask=own["there"] == 0), "start": pa.array(starts + base), "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(sums, pa.int64())}
        yield pa.RecordBatch.from_pydict(out | ({} if raw is None else {"ids": pa.array(raw, pa.binary())}))


def local(path: str) -> str | None:
    """The folder of a file: path; None in any other store."""
    scheme, _, rest = path.partition(":")
    return "/" + rest.lstrip("/") if scheme == "file" else None


def mapped(root: str, name: str, kind: str | np.dtype) -> np.ndarray:
    """A file of numbers or records, memory-mapped."""
    return np.memmap(f"{root}/{name}", dtype=kind, mode="r")


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    root = _path(spark, path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of 16-bit ids under spark.checkpoint.dir, end id 2, and what they hold."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/thicket-{uuid.uuid4().hex}/tokens"
    return write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2).documents()

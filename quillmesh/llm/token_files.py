"""Token ids in binary files: one shared zstandard dictionary, one frame a document.

``write`` encodes whole texts, serializes each document's ids (two bytes an id
where the vocabulary allows it, else four), trains one dictionary on a bounded
sample of such arrays, compresses every document by itself with it, and lays the
frames into files in ascending document order. A folder holds

* ``dictionary.bin``, the dictionary;
* ``files/*.bin``: ``MAGIC``, the bytes of an id, the dictionary's SHA-256, the
  frames, and then the offset index: where each frame begins, each document's id
  and how many ids it has, the number of documents and where the index begins;
* ``index``: the same offsets as Parquet, a row per document.

Short documents are read without their neighbours: ``TokenFiles.fetch`` joins the
wanted ids with the index and reads those ranges only; ``TokenFiles.documents``
reads all files from their own indexes.

Each task writes files of unique names and tells of them in its rows of the index,
which Spark commits; a file of a task that was lost or run twice is in no index
and so is no part of the result. Files go to the folder by ``pyarrow.fs``, so it
may be any store that the executors share and pyarrow can open (local paths,
s3, gs, hdfs, abfs). Driver and tasks never hold more than a file's offsets, a
chunk of frames and one document.

The dictionary is fitted on about ``SAMPLE`` documents, of which the first ``CUT``
ids count; every document is then encoded whole. It changes sizes, never results.

Null texts are empty: they have the end id alone. Documents are in ascending
order of id, null ids first, rows that share an id in the order of a hash of
their text; rows that repeat both are all kept. Texts of any length are one
frame. Empty tables give no file and no row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm._shared import arrow_schema, emit, shared_dir, stage
from quillmesh.llm._tokens import BytePairEncoder

MAGIC = b"QMTOKEN1"
SAMPLE = 2048  #: documents, about, on which the dictionary is trained
CUT = 8192  #: ids of each of them that count
DICTIONARY = 112_640  #: bytes of the dictionary, at most
LEVEL = 3  #: of compression
FILE = 256 << 20  #: bytes of frames in one file, about, where there are more than cores can write
SMALL = 4 << 20  #: bytes of frames for which a file is worth its own task
CHUNK = 4 << 20  #: bytes of frames that are read at once
HEAD, TAIL = "<8sI32s", "<QQ8s"  #: magic, bytes of an id, digest; documents, place of the index, magic
FRAMES = "doc_id long, mark long, deal long, n_tokens long, size long, frame binary"
INDEX = "part int, file string, slot long, doc_id long, at long, size long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
_ENCODERS: dict[str, BytePairEncoder] = {}


def _encoder(path: str) -> BytePairEncoder:
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, BytePairEncoder(path))


def _open(root: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(root)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; of samples too few to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def _codec(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None


def _id_arrays(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, kind: str):
    """For parts of each batch: the part, and each of its documents' serialized ids."""
    end = np.asarray([end_id], "<u4").tobytes()
    encoder = _encoder(vocabulary)
    for b in batches:
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            yield part, [np.frombuffer(raw + end, "<u4").astype(kind).tobytes() for raw in encoder.encode(part.column("text").to_pylist())]


def _sampled(vocabulary: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, arrays in _id_arrays(batches, vocabulary, end_id, kind):
            yield pa.RecordBatch.from_pydict({"ids": [a[: CUT * np.dtype(kind).itemsize] for a in arrays]})

    return run


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    samples = sorted(x for b in batches for x in b.column("ids").to_pylist())
    yield pa.RecordBatch.from_pydict({"dictionary": [train_dictionary(samples)]})


def _frames(vocabulary: str, end_id: int, kind: str, shared):
    _, out = arrow_schema(FRAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        if codec is not None:
            codec.precompute_compress(LEVEL)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=codec, write_checksum=False)
        deal = TaskContext.get().partitionId() << 40
        for part, arrays in _id_arrays(batches, vocabulary, end_id, kind):
            frames = [compressor.compress(a) for a in arrays]
            n = np.array([len(a) for a in arrays], np.int64) // np.dtype(kind).itemsize
            yield emit(out, {"doc_id": part.column("doc_id"), "mark": part.column("mark"), "deal": deal + np.arange(len(n)), "n_tokens": n, "size": np.array([len(f) for f in frames], np.int64), "frame": pa.array(frames, pa.binary())})
            deal += len(n)

    return run


def _written(root: str, width: int, digest: bytes):
    _, out = arrow_schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"{part:08d}-{uuid.uuid4().hex}.bin"
        fs, at = _open(f"{root}/files")
        to, begins, ids, counts = None, [np.zeros(0, np.int64)], [], []
        place = struct.calcsize(HEAD)
        for b in batches:
            if not b.num_rows:
                continue
            if to is None:
                to = fs.open_output_stream(f"{at}/{name}")
                to.write(struct.pack(HEAD, MAGIC, width, digest))
            to.write(b"".join(b.column("frame").to_pylist()))
            size = b.column("size").to_numpy()
            begin = place + np.cumsum(size) - size
            slot = sum(map(len, begins)) + np.arange(len(size))
            yield emit(out, {"part": np.full(len(size), part, np.int32), "file": pa.array([name] * len(size)), "slot": slot, "doc_id": b.column("doc_id"), "at": begin, "size": size, "n_tokens": b.column("n_tokens")})
            begins.append(begin)
            ids.append(b.column("doc_id").fill_null(-(1 << 63)).to_numpy())
            counts.append(b.column("n_tokens").to_numpy())
            place += int(size.sum())
        if to is not None:
            table = [np.r_[np.concatenate(begins), place], np.concatenate(ids), np.concatenate(counts)]
            to.write(b"".join(x.astype("<i8").tobytes() for x in table))
            to.write(struct.pack(TAIL, len(table[1]), place, MAGIC))
            to.close()

    return run


class Reader:
    """One file of tokens: its index, and any of its documents."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, dictionary: bytes):
        self.source = fs.open_input_file(path)
        magic, self.width, digest = struct.unpack(HEAD, self._range(0, struct.calcsize(HEAD)))
        n, self.end, last = struct.unpack(TAIL, self._range(self.source.size() - (tail := struct.calcsize(TAIL)), tail))
        if magic != MAGIC or last != MAGIC:
            raise ValueError(f"{path} is not a whole file of tokens")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        raw = np.frombuffer(self._range(self.end, 8 * (3 * n + 1)), "<i8")
        self.at, self.ids, self.counts = raw[: n + 1], raw[n + 1 : 2 * n + 1], raw[2 * n + 1 :]
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_codec(dictionary))

    def _range(self, at: int, size: int) -> bytes:
        return self.source.read_at(size, at)

    def __len__(self) -> int:
        return len(self.ids)

    def _ids_of(self, frame, slot: int) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        raw = self.decompressor.decompress(frame)
        if len(raw) != self.counts[slot] * self.width:
            raise ValueError("a frame holds another number of ids than its index says")
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4").tobytes()

    def one(self, slot: int) -> bytes:
        return self._ids_of(self._range(int(self.at[slot]), int(self.at[slot + 1] - self.at[slot])), slot)

    def runs(self) -> Iterator[tuple[int, list[bytes]]]:
        """All documents from chunk to chunk: the first one's slot, and their ids."""
        lo = 0
        while lo < len(self):
            hi = max(lo + 1, int(np.searchsorted(self.at, self.at[lo] + CHUNK, "right")) - 1)
            chunk = memoryview(self._range(int(self.at[lo]), int(self.at[hi] - self.at[lo])))
            edges = (self.at[lo : hi + 1] - self.at[lo]).tolist()
            yield lo, [self._ids_of(chunk[a:b], lo + i) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
            lo = hi


def _rows(out: pa.Schema, slots: list[int], reader: Reader, starts: np.ndarray, ids: list[bytes], with_ids: bool) -> pa.RecordBatch:
    docs = [None if d == -(1 << 63) else d for d in reader.ids[slots].tolist()]
    columns = {"doc_id": pa.array(docs, pa.int64()), "start": starts[slots], "n_tokens": np.array([len(x) // 4 for x in ids], np.int64), "ids_crc32": np.array([zlib.crc32(x) for x in ids], np.int64)}
    return emit(out, columns | {"ids": pa.array(ids if with_ids else [None] * len(ids), pa.binary())})


class TokenFiles:
    """A folder of token files, to be read as DataFrames."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        fs, at = _open(self.root)
        with fs.open_input_stream(f"{at}/dictionary.bin") as f:
            self.dictionary = f.read()

    def index(self) -> DataFrame:
        """file, slot, doc_id, at, size, n_tokens: where each document's frame is."""
        return self.spark.read.schema(INDEX).parquet(f"{self.root}/index")

    def files(self) -> DataFrame:
        """file, docs, tokens, and ``first``: the ids in all files before it. One row a
        file, so the running sum over files is a short one."""
        each = self.index().groupBy("part", "file").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        return each.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def documents(self, with_ids: bool = False) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 (and ids, as little-endian unsigned
        32-bit integers) of every document, as the files have them."""
        root, shared, (_, out) = self.root, self.spark.sparkContext.broadcast(self.dictionary), arrow_schema(READ)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, at = _open(f"{root}/files")
            for b in batches:
                for file, first in zip(b.column("file").to_pylist(), b.column("first").to_pylist(), strict=True):
                    reader = Reader(fs, f"{at}/{file}", shared.value)
                    starts = first + np.cumsum(reader.counts) - reader.counts
                    for lo, ids in reader.runs():
                        yield _rows(out, list(range(lo, lo + len(ids))), reader, starts, ids, with_ids)

        files = stage(self.files(), "files").select("file", "first")
        read = files.repartition(max(1, files.count()), "file").mapInArrow(run, READ)
        return read if with_ids else read.drop("ids")

    def fetch(self, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """The same of the documents whose ids ``wanted`` holds; only their ranges,
        and the indexes of their files, are read."""
        root, shared, (_, out) = self.root, self.spark.sparkContext.broadcast(self.dictionary), arrow_schema(READ)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, at = _open(f"{root}/files")
            held, reader, starts = None, None, None
            for b in batches:
                for file, first, slot in zip(*(b.column(c).to_pylist() for c in ("file", "first", "slot")), strict=True):
                    if file != held:  # rows come file by file
                        held, reader = file, Reader(fs, f"{at}/{file}", shared.value)
                        starts = first + np.cumsum(reader.counts) - reader.counts
                    yield _rows(out, [slot], reader, starts, [reader.one(slot)], True)

        ids = wanted.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
        found = self.index().join(ids, "doc_id", "left_semi").join(self.files().select("file", "first"), "file").select("file", "first", "slot")
        return found.repartition("file").sortWithinPartitions("file", "slot").mapInArrow(run, READ)


def write(docs: DataFrame, vocabulary: str, root: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE) -> TokenFiles:
    """Write every document's ids to files under ``root`` (a new folder beside the
    session's checkpoints, if none is given)."""
    spark = docs.sparkSession
    root = (root or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}").rstrip("/")
    fs, at = _open(root)
    fs.create_dir(f"{at}/files", recursive=True)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("mark", F.xxhash64("doc_id", "text"))
    kind = "<u2" if max(_encoder(vocabulary).largest, end_id) < 1 << 16 else "<u4"

    share = min(1.0, SAMPLE / max(1, docs.count()))
    drawn = texts.filter(F.pmod(F.xxhash64("mark", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn.groupBy("mark").agg(F.first("text").alias("text"))  # a repeated row counts once
    samples = drawn.mapInArrow(_sampled(vocabulary, end_id, kind), "ids binary")
    trained = samples.repartition(1).mapInArrow(_trained, "dictionary binary").collect()  # one row, of DICTIONARY bytes at most
    dictionary = bytes(trained[0][0]) if trained else b""
    with fs.open_output_stream(f"{at}/dictionary.bin") as f:
        f.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    frames = stage(texts.mapInArrow(_frames(vocabulary, end_id, kind, shared), FRAMES), "frames")
    total = frames.agg(F.sum("size")).first()[0] or 0
    files = max(1, -(-total // file_bytes), min(-(-total // SMALL), spark.sparkContext.defaultParallelism))
    # the hash and the place in the task that read it deal out what one id has many of
    ranged = frames.repartitionByRange(files, "doc_id", "mark", "deal").sortWithinPartitions("doc_id", "mark", "deal")
    ranged.mapInArrow(_written(root, np.dtype(kind).itemsize, hashlib.sha256(dictionary).digest()), INDEX).write.parquet(f"{root}/index")
    return TokenFiles(spark, root)

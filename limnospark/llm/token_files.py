"""Documents as files of token ids (op 11): :mod:`.pfor` blocks, written and
read by Spark tasks.

Documents are put in ascending order of their key by a range partitioning, so
file after file holds the ids of one long sequence; each document ends with
``end_id``. A task encodes its range and writes one file; what it returns is
the file's line of the manifest, so a lost or repeated attempt leaves a file
that no manifest names. :func:`read` opens the manifest's files, decodes their
blocks and gives a line per document; a document's place in the whole sequence
is its place in the file plus the ids of all files before.

Encoding. The library splits a text into pieces (letters, one digit, other
signs, white space dropped) and encodes each by itself, so the ids of a piece
are looked up once per task. Texts of plain letters are split here by the same
rule; any other text goes to the library whole. Both give the library's ids.

Files are opened through ``pyarrow.fs``: the shared folder has to be of a kind
it knows (file, hdfs, s3, gs).

Defined cases: a null text is empty and has the end id only; a null key comes
first and stays null; rows of one key come in the order of (hash of the text,
text), so equal rows are alike; an empty table gives no file and no row. Only
key and text are read, whatever else the columns are called.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from ..session import ensure_checkpoint_dir
from . import pfor
from .batches import portions
from .common import ship, tasks, text_of, written

ship(__name__)

VOCABULARY = "word_bpe_49k.json"
END = 1
#: Pieces whose ids a task keeps; beyond it the table starts anew.
KEPT = 1 << 18

# Letters whose lower case and pieces are the same here as in
# the library (ASCII and the composed letters of Latin-1), and its split rule
# on lower-case texts of these. A text with a special token's opening is left
# to the library.
PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-z0-9ß-öø-ÿ]+")
OPENING = "<|"


class Places(dict):
    """piece -> its number; a piece asked for the first time gets the next
    one and waits in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


def loaded(path: str, split: bool) -> Tokenizer:
    """The library's tokenizer; with ``split`` for pieces that are normalised
    and split already. A worker process keeps it from task to task, and does
    not encode in threads of its own beside the other tasks."""
    kept = vars(tokenizers).setdefault("_kept", {})
    if (path, split) not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = kept[path, split] = Tokenizer.from_file(path)
        if split:
            t.normalizer = normalizers.Sequence([])
            t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return kept[path, split]


class Encoder:
    """Ids of texts by the library's model, pieces looked up once."""

    def __init__(self, path: str):
        self.path = path
        self.piece = loaded(path, True)
        self.clear()

    def clear(self) -> None:
        self.places = Places()
        self.ends = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def learn(self) -> None:
        """Ids of the pieces that wait."""
        got = [e.ids for e in self.piece.encode_batch_fast(self.places.new, add_special_tokens=False)]
        self.places.new = []
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in got], dtype=np.int64)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), np.uint32)])

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in loaded(self.path, False).encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [bool(PLAIN.fullmatch(t)) and OPENING not in t for t in texts]
        odd = iter(self.library([t for t, ok in zip(texts, plain) if not ok]))
        split = [PIECE.findall(t.lower()) if ok else [] for t, ok in zip(texts, plain)]
        if len(self.places) > KEPT:
            self.clear()
        n = sum(map(len, split))
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(split)), np.int64, n)
        self.learn()
        counts = self.ends[at + 1] - self.ends[at]
        ids = self.flat[pfor.spread(self.ends[at], counts)]
        cuts = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *map(len, split)])]
        return [ids[cuts[i]:cuts[i + 1]] if ok else next(odd) for i, ok in enumerate(plain)]


@dataclass
class TokenFiles:
    """The folder and its manifest: (number, path, ids before the file, bytes)
    per file, in order, a line per range of documents; ids of all files."""

    folder: str
    files: list[tuple[int, str, int, int]]
    ids: int


def write(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end_id: int = END,
          batch_bytes: int = 1 << 20) -> TokenFiles:
    """Encode every row's text and write the files into the shared folder."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/limnospark-tokens-{uuid.uuid4().hex[:12]}"
    path = public_tokenizers.path(vocabulary)
    rows = df.select(F.col(key).cast("long").alias("k"), text_of(text).alias("t")).withColumn("h", F.xxhash64("t"))
    # Rows alike in key and text may be many; any order of them is the same.
    dealt = rows.repartitionByRange(tasks(spark), "k", "h", F.monotonically_increasing_id())
    dealt = dealt.sortWithinPartitions("k", "h", "t").select("k", "t")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        place, where = fs.FileSystem.from_uri(folder)
        name = f"{where}/part-{number:06d}-{uuid.uuid4().hex[:8]}.pfor"
        encoder = out = stream = None

        for b in batches:
            if len(b) and out is None:
                place.create_dir(where, recursive=True)
                stream = place.open_output_stream(name)
                encoder, out = Encoder(path), pfor.Writer(stream)
            for part in portions(b, 1, batch_bytes):
                for k, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    out.add(k, np.append(ids, np.uint32(end_id)))
        if out is not None:
            n = out.close()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"file": number, "name": name, "ids": out.ids, "bytes": n}])

    shape = "file long, name string, ids long, bytes long"
    manifest = written(dealt.mapInArrow(store, shape), "token-manifest").orderBy("file").collect()
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(root)
    files, before = [], 0
    for r in manifest:
        files.append((r["file"], r["name"], before, r["bytes"]))
        before += r["ids"]
    return TokenFiles(folder, files, before)


def read(spark, tokens: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, all from the files."""
    shape = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not tokens.files:
        return spark.createDataFrame([], shape)
    folder = tokens.folder

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = fs.FileSystem.from_uri(folder)[0]
        for b in batches:
            for r in b.to_pylist():
                with place.open_input_file(r["name"]) as stream:
                    file = pfor.Reader(stream, r["bytes"])
                    crc = np.zeros(len(file.keys), np.int64)
                    for i, ids in file.pieces():
                        crc[i] = zlib.crc32(ids.tobytes(), int(crc[i]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.keys, pa.int64()), pa.array(file.firsts[:-1] + r["before"]), pa.array(np.diff(file.firsts)), pa.array(crc)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    lines = spark.createDataFrame(tokens.files, "file long, name string, before long, bytes long")
    return lines.repartition(min(len(tokens.files), tasks(spark))).mapInArrow(load, shape)


def report(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end_id: int = END) -> DataFrame:
    return read(df.sparkSession, write(df, key, text, vocabulary, end_id))

"""Token ids as flat files of unsigned integers with 64-bit document offsets, written and memory-mapped by tasks.

A shard is three files: `.bin` holds the ids of its documents one after another in the narrowest unsigned type that the
vocabulary fits, `.off` the position of each document's first id and at last the number of ids (64-bit), `.doc` the
document ids (64-bit, a null as the smallest integer). Shards follow one another in ascending document id, so a shard's
base in the whole corpus is the prefix sum of the shards' lengths: one number a shard, all that the driver sees.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.llm.shared import partitions, shared_path

#: Words and letter runs that a Python worker remembers at most (about 45 MB each); a full memory is emptied, which costs time but changes no id.
MEMO_WORDS = 220_000
NULL_DOC = -(2**63)

_memo: dict[tuple, dict] = {}

#: The character that byte-level tokenizers write for each byte; printable ones stand for themselves.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def id_type(vocabulary: int) -> str:
    """Little-endian unsigned type for ids below `vocabulary`."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encoder(path: str, end_id: int) -> tuple[str, Callable[[list[str]], list[bytes]]]:
    """(id type, function from texts to their ids as bytes, each with end_id at its end) for a tokenizers file.

    Where the tokenizer is byte-level and never joins anything across spaces or between letters and marks (it is asked,
    not assumed), words and letter runs already seen are taken from a memory; else whole texts are encoded.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_file(path)
    kind = id_type(max(tok.get_vocab_size(), end_id + 1))
    end = np.array([end_id], kind).tobytes()
    as_bytes = lambda ids: np.array(ids, kind).tobytes()

    def whole(texts: list[str]) -> list[bytes]:
        return [as_bytes(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    probe = "ab., C\u00c9\n?e"
    if tok.pre_tokenizer is None or tok.encode(probe, add_special_tokens=False).ids != [i for p in ("ab", ".,", "c\u00e9", "?", "e") for i in tok.encode(p, add_special_tokens=False).ids]:
        return kind, lambda texts: [x + end for x in whole(texts)]
    pieces = [p for p, _ in tok.pre_tokenizer.pre_tokenize_str("ab., c\u00e9\n?e")]
    model_only = lambda run: [t.id for t in tok.model.tokenize("".join(map(_BYTE_CHARS.__getitem__, run.encode())))]
    if len(pieces) != 5 or any(model_only(w) != tok.encode(w.upper(), add_special_tokens=False).ids for w in ("ab", "tokenizers", "c\u00e9l\u00e8bre")):
        return kind, lambda texts: [x + end for x in whole(texts)]

    memory = _memo.setdefault((path, end_id), _Words(lambda run: as_bytes(model_only(run)), lambda text: whole([text])[0]))
    look = memory.__getitem__
    return kind, lambda texts: [b"".join(map(look, text.replace("\n", " ").split(" "))) + end for text in texts]


class _Words(dict):
    """Ids of words seen so far. A word of Latin-1 letters and marks is the ids of its letters, then of its marks."""

    SIMPLE = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?|*#%$&]*)")

    def __init__(self, of_run: Callable[[str], bytes], of_text: Callable[[str], bytes]):
        super().__init__()
        self.of_run, self.of_text, self.runs = of_run, of_text, {}

    def __missing__(self, word: str) -> bytes:
        for known in (self, self.runs):
            if len(known) >= MEMO_WORDS:
                known.clear()
        m = self.SIMPLE.fullmatch(word)
        if m is None:
            ids = self.of_text(word)
        else:
            run, marks = m[1].lower(), m[2]
            ids = self.runs.get(run)
            if ids is None:
                ids = self.runs[run] = self.of_run(run)
            if marks:
                tail = self.runs.get(marks)
                if tail is None:
                    tail = self.runs[marks] = self.of_text(marks)
                ids += tail
        self[word] = ids
        return ids


def local_path(path: str) -> str:
    """A path that tasks can open and map: the shared folder has to be mounted on every machine."""
    u = urlparse(path)
    if u.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped token files need a mounted shared folder, not {u.scheme}://")
    return u.path if u.scheme else path


def write_token_files(docs: DataFrame, doc_id: str, text: str, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Write docs to `folder` in ascending doc_id order (nulls first); return (shard, n_docs, n_tokens), one row a shard.

    Each task sorts and encodes one range of ids and writes its files under a name of its own attempt, then renames
    them: a task that runs twice leaves one whole shard. Rows with equal ids stay neighbours, in the order of their
    texts; a null text is an empty one, that is the end id alone; an empty table writes no shard.
    """
    target = local_path(folder)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId()
        kind, encode = encoder(tokenizer, end_id)
        os.makedirs(target, exist_ok=True)
        name = os.path.join(target, f"shard-{shard:06d}")
        mine = f"{name}.{task.taskAttemptId()}"
        width, n, total = np.dtype(kind).itemsize, 0, 0
        with open(mine + ".bin", "wb") as ids, open(mine + ".off", "wb") as offsets, open(mine + ".doc", "wb") as names:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    encoded = encode(part.column(1).to_pylist())
                    sizes = np.array([len(x) for x in encoded], np.int64) // width
                    (total + np.concatenate(([0], np.cumsum(sizes)[:-1]))).astype("<i8").tofile(offsets)
                    part.column(0).fill_null(NULL_DOC).to_numpy(zero_copy_only=False).astype("<i8").tofile(names)
                    ids.writelines(encoded)
                    n, total = n + len(encoded), total + int(sizes.sum())
            np.array([total], "<i8").tofile(offsets)
        for end in (".bin", ".off", ".doc"):
            os.replace(mine + end, name + end) if n else os.remove(mine + end)
        if n:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    return rows.mapInArrow(write, "shard int, n_docs long, n_tokens long")


def read_token_files(spark: SparkSession, shards: DataFrame, folder: str, kind: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; `shards` is what writing returned.

    start counts the ids of all documents before it. A task maps its shards and reads each document's ids once.
    """
    target = local_path(folder)
    bases = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = os.path.join(target, f"shard-{row['shard']:06d}")
                ids, off, doc = (np.memmap(name + end, dtype, "r") for end, dtype in ((".bin", kind), (".off", "<i8"), (".doc", "<i8")))
                for at in range(0, len(doc), 4096):
                    o = np.asarray(off[at : at + 4097])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                    d = np.asarray(doc[at : at + 4096])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d, pa.int64(), mask=d == NULL_DOC), pa.array(o[:-1] + row["base"], pa.int64()), pa.array(np.diff(o), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    return bases.select("shard", "base").repartition(partitions(spark), "shard").mapInArrow(read, schema)


def token_table(docs: DataFrame, doc_id: str, text: str, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write token files to `folder` (a new shared one if not given) and read them back, one row a document."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    kind = id_type(max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1))
    manifest = f"{folder}/manifest"
    write_token_files(docs, doc_id, text, tokenizer, end_id, folder).write.parquet(manifest)
    shards = spark.read.schema("shard int, n_docs long, n_tokens long").parquet(manifest)
    return read_token_files(spark, shards, folder, kind)

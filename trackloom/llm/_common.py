"""What the text operators share: tables, folds, UTF-8 buffers and word hashing in numpy."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised pass handles; a longer single text is a pass of its own.
CHUNK = 2 << 20

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset, a new temporary folder if Spark runs on one machine, else an error."""
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_:
        return set_
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all machines share")
    return _own.setdefault("folder", os.path.join(tempfile.gettempdir(), f"shared-{uuid.uuid4().hex}"))


_own: dict[str, str] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, lineage cut."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that Spark wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*dfs: DataFrame) -> None:
    """Delete the files of checkpointed tables that nothing reads any more."""
    for df in dfs:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            remove(df.sparkSession, file.get())


def unused(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, whatever the case of its letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array without nulls, and the n + 1 offsets into them."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of successive row ranges holding about ``size`` bytes each, never part of a row."""
    raw, at = buffers(texts)
    n, first = len(texts), 0
    while first < n:
        end = int(np.searchsorted(at, at[first] + size, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


#: Slices of more bytes are hashed one by one.
_LONG = 512
_KEY = b"slices of text"
_TAIL = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def slice_digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, halves: int = 2) -> list[np.ndarray]:
    """A 128-bit hash of every slice raw[start:end], as two arrays of 64 bits; ``halves`` = 1 gives the first only.

    Eight bytes at a time go through a bijective mixer, with the length as the seed, so slices of the same length up to eight bytes never
    share a hash and no structure of longer ones cancels out; slices of more than ``_LONG`` bytes get a keyed BLAKE2 hash.
    """
    n = len(starts)
    length = (ends - starts).astype(np.int64)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    seeds = mix(length.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(0x2545F4914F6CDD1D))
    out = [seeds, mix(seeds + np.uint64(0x9FB21C651E98DF25))][:halves]
    factor = (np.uint64(1), np.uint64(0x9E3779B97F4A7C15))
    active, place = np.flatnonzero(length <= _LONG), 0
    active = active[length[active] > 0]
    with np.errstate(over="ignore"):
        while len(active):
            block = eight[starts[active] + place] & _TAIL[np.minimum(length[active] - place, 8)]
            for half, f in zip(out, factor, strict=False):
                half[active] = mix(half[active] ^ (block * f))
            place += 8
            active = active[length[active] > place]
    for i in np.flatnonzero(length > _LONG).tolist():
        digest = np.frombuffer(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=16, key=_KEY).digest(), np.uint64)
        for half, d in zip(out, digest, strict=False):
            half[i] = d
    return out


def slice_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 64 bits of ``slice_digests``."""
    return slice_digests(raw, starts, ends, 1)[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[raw]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs without ASCII white space) and the row of each, for rows at offsets ``at``."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed integer, as Spark's LongType has it."""
    return x.view(np.int64)

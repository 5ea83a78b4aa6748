"""Small helpers shared by the corpus operators: shared scratch tables, Arrow access and connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``; a temporary one only in a local session."""
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="touchline-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, and gives Spark exact sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that Spark wrote."""
    fs, jpath = _hadoop(spark, path)
    fs.delete(jpath, True)


def renamed(spark: SparkSession, path: str, to: str) -> None:
    """Move a folder that is complete to its final name."""
    fs, jpath = _hadoop(spark, path)
    if not fs.rename(jpath, _hadoop(spark, to)[1]):
        raise OSError(f"{path} can't be moved to {to}")


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, without those begun but not complete (a leading dot)."""
    fs, jpath = _hadoop(spark, path)
    if not fs.exists(jpath):
        return []
    return [n for f in fs.listStatus(jpath) if f.isDirectory() and not (n := f.getPath().getName()).startswith(".")]


def unstore(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            remove(spark, path)


def release(spark: SparkSession) -> None:
    """Let the driver forget finished plans now, so that their shuffle files leave the disks.

    Two rounds: plans that the first one frees are noticed, and their files deleted, after the second.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.6)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores before it until no column of ``df`` has it, in either case."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name = "_" + name
        there.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    """Strings of a string column; null is empty."""
    return [s or "" for s in column.to_pylist()]


#: Letters of a word that are hashed for all words at once.
SHORT = 64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)[LOWER]
_ODD, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_in(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, first and last place of each word, words per text); words are runs without ASCII white space."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    kind = np.int32 if len(raw) < 1 << 31 else np.int64
    begin = (np.flatnonzero(space[:-1] & ~space[1:]) + 1).astype(kind)
    last = np.flatnonzero(~space[:-1] & space[1:]).astype(kind)
    text_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return raw, begin, last, np.diff(np.searchsorted(begin, text_end, "right"), prepend=0)


def word_hashes(raw: np.ndarray, begin: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, A-Z lower-cased: letter by letter, all words at once, longest first; words beyond ``SHORT``
    letters one by one."""
    short = np.minimum(last - begin + 1, SHORT + 1).astype(np.uint8)
    order = np.argsort(short, kind="stable")[::-1]
    first, many = begin[order], len(order) - np.cumsum(np.bincount(short, minlength=SHORT + 2))
    h = np.zeros(len(order), np.uint64)
    for i in range(SHORT):
        m = int(many[i])  # words of more than i letters
        if not m:
            break
        h[:m] ^= _LETTER[raw[first[:m] + i]]
        h[:m] *= _ODD
        h[:m] ^= h[:m] >> np.uint64(29)
    h *= _END
    h ^= h >> np.uint64(32)
    out = np.empty(len(order), np.uint64)
    out[order] = h
    for k in order[: int(many[SHORT])].tolist():
        out[k] = xxhash.xxh64_intdigest(raw[begin[k] : last[k] + 1].tobytes().lower())
    return out


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches from an iterator of tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Label every vertex of ``edges(a, b)`` with the smallest vertex it can reach: columns ``id, comp``.

    Alternating large-star and small-star steps; each is two shuffles with map-side ``min``, so a hub with
    very many neighbours is pre-aggregated.  Every round is written to the shared folder.  Links stay distributed.
    """
    cur = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _fingerprint(cur)
    for _ in range(rounds):
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        nxt = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        unstore(cur)
        cur, before = nxt, mark
        mark = _fingerprint(cur)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = cur.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "id")
    roots = cur.select(F.col("v").alias("id")).distinct().join(members.select("id"), "id", "left_anti")
    return members.unionAll(roots.withColumn("comp", F.col("id")))


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of distinct edges and two order-free sums of their hashes."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def crc32_mod(column: Column, n: int) -> Column:
    """crc32 of a value's decimal text, modulo ``n``."""
    return F.crc32(column.cast("string").cast("binary")) % n

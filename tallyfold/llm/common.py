"""What the operators of this subpackage share: the shared folder, table access, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB, unless the session has a bound of its own: by default Spark makes them of 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, "4m")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A driver table with only the named columns (column pruning reaches the scan)."""
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the session runs in one process (tests, a laptop) a temporary
    folder is made and set; it goes when the process ends. On a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[[^-]|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tallyfold-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{base}")
        base = f"file://{base}"
    return base.rstrip("/")


class Scratch:
    """A folder of its own below the shared folder for the written tables of one run.

    What a lazy result still reads stays until the driver ends, then the folder goes. options: of Parquet's writer.
    """

    def __init__(self, spark: SparkSession, name: str, **options: str):
        self.options = {"compression": "zstd"} | options
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._at(self.path, "deleteOnExit")

    def _at(self, path: str, call: str, *args) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        getattr(where.getFileSystem(self.spark._jsc.hadoopConfiguration()), call)(where, *args)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Cuts the lineage: df is written as Parquet and read again."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").options(**self.options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that no later plan reads."""
        for name in names:
            self._at(f"{self.path}/{name}", "delete", True)

    def release(self, *names: str) -> None:
        """As drop, and lets go of the shuffle files of plans that are done.

        They stay on the executors' disks until the driver's collector has found their plans.
        """
        self.drop(*names)
        for _ in range(2):  # the first finds Python's handles of a plan, the second the plan
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.25)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from the given columns."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text):
    """Lower-cases A-Z only, as the contracts ask."""
    return F.translate(text, UPPER, LOWER)


def clean(text: object) -> str:
    """A cell of a pandas text column: null counts as empty."""
    return text if isinstance(text, str) else ""


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


@contextmanager
def task_memory() -> Iterator[None]:
    """Around the work of a task: what it took and let go of goes back to the system at its end.

    A worker outlives its tasks and waits beside the next stage's workers; without this each keeps
    the peak of all tasks that it ever ran.
    """
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


class Memo:
    """A bounded memory of two generations: once the young one holds `bytes_` it becomes the old one.

    What is in use moves along, and the whole never takes more than about twice `bytes_`.
    """

    def __init__(self, bytes_: int = 12 << 20, each: int = 200):
        self.young, self.old, self.most = {}, {}, max(1, bytes_ // each)

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        self.young[key] = value


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound so that memory doesn't grow."""

    def __init__(self, bound: int = 150_000):
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd base of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
_POWERS = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    have = _POWERS.get("p")
    if have is None or len(have[0]) < n:
        n2 = max(n, 4096) * 2
        up = np.full(n2, BASE, np.uint64)
        down = np.full(n2, UNBASE, np.uint64)
        up[0] = down[0] = 1
        have = _POWERS["p"] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if n2 > 4_000_000:  # a very long text: not kept
            _POWERS.clear()
    return have[0][:n], have[1][:n]


def prefix_sums(hashes: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of hashes[j] * BASE**j for j < i, modulo 2**64."""
    up, _ = powers(len(hashes))
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of the word spans [start, end): equal spans have equal hashes."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(BASE))


#: The low n bytes of eight, by n.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG = 64
#: What a word's hash begins with, by its size.
_SIZED = mix(np.arange(1 << 12, dtype=np.uint64) * np.uint64(BASE) + np.uint64(1))


class Words:
    """The words of several texts as arrays: no Python object is made for a word.

    data: the texts' bytes with a line feed after each; offset: of each text; start, end: of each
    word; at: the first word of each text, and one more; line: the line feeds before each word;
    hash: 64 bits of each word's bytes.
    """

    def __init__(self, texts: list[bytes]):
        whole = b"\n".join([*texts, b""])
        self.data = data = np.frombuffer(whole, np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        # space, tab, line feed, vertical tab, form feed, carriage return part words
        gaps = np.flatnonzero((data == 32) | (data - np.uint8(9) < 5))
        start = np.concatenate([[0], gaps[:-1] + 1]) if len(gaps) else gaps
        solid = gaps > start
        self.start, self.end = start[solid], gaps[solid]
        feeds = np.flatnonzero(data[gaps] == 10)
        self.breaks = gaps[feeds]
        # the words up to each line feed belong to its line
        self.line = np.repeat(np.arange(len(feeds)), np.diff(np.cumsum(solid)[feeds], prepend=0))
        self.at = np.searchsorted(self.start, self.offset)
        self.hash = self._hash(whole)

    def _hash(self, whole: bytes) -> np.ndarray:
        eight = np.ndarray((len(whole),), "<u8", whole + bytes(8), 0, (1,))  # the eight bytes from each place on
        size = self.end - self.start
        out = _SIZED[size] if size.max(initial=0) < len(_SIZED) else mix(size.astype(np.uint64) * np.uint64(BASE) + np.uint64(1))
        at, left, which = self.start, np.where(size > _LONG, 0, size), slice(None)
        for _ in range(_LONG // 8):
            out[which] = mix(out[which] * np.uint64(BASE) ^ (eight[at] & _LOW[np.minimum(left, 8)]))
            more = np.flatnonzero(left > 8)
            if not len(more):
                break
            which = more if isinstance(which, slice) else which[more]
            at, left = at[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > _LONG):
            out[i] = xxhash.xxh3_64_intdigest(whole[self.start[i] : self.end[i]])
        return out


def pieces(col: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(start, slice) of a column of texts in order, each of about `size` bytes or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield at, col.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def by_text(make, kind: str):
    """A column function of a text column: make() gives, once in each task, list of texts -> Arrow array.

    The text goes to Python once and only the result comes back; other columns stay where they are.
    """

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with task_memory():
            work = make()
            for col in batches:
                done = [work(["" if t is None else t for t in part.to_pylist()]) for _, part in pieces(col)]
                yield pa.concat_arrays(done) if done else work([])

    return run


def map_texts(rows: DataFrame, text_col: str, keep: dict[str, str], schema: str, make) -> DataFrame:
    """One pass over whole texts in Arrow batches: no shuffle, nulls count as empty texts.

    keep: output column -> SQL expression of what is passed through untouched. make() is called
    once in each worker and gives a function from a list of texts to the added columns. A batch
    is handed over in pieces of a MB, so that long texts don't add up.
    """
    given = rows.selectExpr(*(f"{e} AS `{c}`" for c, e in keep.items()), f"`{text_col}` AS _text")
    columns = ", ".join(f"`{c}` {t}" for c, t in given.dtypes if c in keep) + ", " + schema
    kept = list(keep)

    def run(batches):
        with task_memory():
            work = make()
            for batch in batches:
                n = batch.num_rows
                texts = batch.column(batch.schema.get_field_index("_text"))
                step = max(1, int(n * (1 << 20) / max(1, texts.nbytes)))
                for at in range(0, n, step):
                    part = batch.slice(at, step)
                    added = work(["" if t is None else t for t in texts.slice(at, step).to_pylist()])
                    out = {c: part.column(part.schema.get_field_index(c)) for c in kept}
                    yield pa.RecordBatch.from_pydict(out | {c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in added.items()})

    return given.mapInArrow(run, columns)


def map_texts_many(rows: DataFrame, text_col: str, keep: dict[str, str], schema: str, make) -> DataFrame:
    """As map_texts, but work() gives any number of rows for a text: their counts, and flat columns.

    work gets the texts and the batch (for kept columns that it needs).
    """
    given = rows.selectExpr(*(f"{e} AS `{c}`" for c, e in keep.items()), f"`{text_col}` AS _text")
    kept = [c for c in keep if not c.startswith("_in_")]
    columns = ", ".join([f"`{c}` {t}" for c, t in given.dtypes if c in kept] + [schema])

    def run(batches):
        with task_memory():
            work = make()
            for batch in batches:
                n = batch.num_rows
                texts = batch.column(batch.schema.get_field_index("_text"))
                step = max(1, int(n * (1 << 20) / max(1, texts.nbytes)))
                for at in range(0, n, step):
                    part = batch.slice(at, step)
                    counts, added = work(["" if t is None else t for t in texts.slice(at, step).to_pylist()], part)
                    index = pa.array(np.repeat(np.arange(part.num_rows), counts))
                    out = {c: part.column(part.schema.get_field_index(c)).take(index) for c in kept}
                    yield pa.RecordBatch.from_pydict(out | {c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in added.items()})

    return given.mapInArrow(run, columns)

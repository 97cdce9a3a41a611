"""Helpers shared by the training-data operators: tables in the shared folder, bounded batches, hashing."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        import chronofold

        root = Path(chronofold.__file__).parent
        target = Path(tempfile.mkdtemp(prefix="chronofold-")) / "chronofold.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        atexit.register(shutil.rmtree, target.parent, True)
        _SHIPPED.add(app)


LOCAL_SHARED = "/tmp/checkpoints/chronofold"
_LOCAL: list[str] = []
_OPENED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``. Where it is unset, a local folder in local mode; elsewhere an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(f"{LOCAL_SHARED}/{uuid.uuid4().hex[:8]}")
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


def _delete(jvm, conf, path: str) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def new_path(spark: SparkSession, tag: str) -> str:
    """A new place below the application's own folder in the shared one, which is deleted when the driver's Python ends."""
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if own not in _OPENED:
        _OPENED.add(own)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

        def end() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone
                _delete(jvm, conf, own)

        atexit.register(end)
    return f"{own}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back, which cuts its lineage. ``discard`` deletes the table."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        _delete(spark._jvm, spark._jsc.hadoopConfiguration(), t._written_to)


#: rows of one key that a join gives to one task, and hot keys that may be broadcast
HOT_ROWS, BROADCAST_HOT = 1000, 200_000


def dealt(large: DataFrame, small: DataFrame, key: str, by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equality join on ``key`` with a column ``__salt`` to be joined on too.

    A key with over ``HOT_ROWS`` rows in ``large`` (which is read twice: hand in a written table) is dealt by the hash of ``by`` to parts of about so many;
    ``small`` has its rows for each part. Other keys have the one salt 0.
    """
    hot = large.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > HOT_ROWS).select(key, F.ceil(F.col("__n") / HOT_ROWS).alias("__parts"))
    hot = materialize(hot, "hot")
    known = F.broadcast(hot) if hot.count() <= BROADCAST_HOT else hot
    left = large.join(known, key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    right = small.join(known, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)).cast("int") - 1))).drop("__parts")
    return left, right


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Before Python runs on executors. Arrow batches are bounded by rows only, so a batch of long texts must have few of them.

    The setting is the session's, and is read when a plan runs, so it stays in force after the call.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


# fixed values: constants of the splitmix64 finaliser
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_LONG = 1 << 21
_TABLES: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    """At least ``n`` powers of the base, or of its inverse, modulo 2 ** 64."""
    if len(_TABLES.get(inverse, ())) < n:
        p = np.full(max(2 * n, 1 << 16), pow(_BASE, -1, 1 << 64) if inverse else _BASE, dtype=np.uint64)
        p[0] = 1
        _TABLES[inverse] = np.cumprod(p, dtype=np.uint64)
    return _TABLES[inverse]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edge[::2], edge[1::2]


def token_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs: sums of byte code times power of its place, mixed with the length."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    if len(b) <= _LONG:  # differences of running sums, moved back to place 0 by the inverse power
        total = np.empty(len(b) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[b] * _powers(len(b))[:len(b)], out=total[1:])
        return mix64((total[ends] - total[starts]) * _powers(len(b), True)[starts] ^ (lengths.astype(np.uint64) * _M2))
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    value = _BYTE[b[place + np.repeat(starts, lengths)]] * _powers(int(lengths.max()) + 1)[place]
    return mix64(np.add.reduceat(value, first) ^ (lengths.astype(np.uint64) * _M2))


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the maximal runs of bytes other than space and 0x09-0x0D, in order."""
    b = np.frombuffer(data, dtype=np.uint8)
    return token_hashes(b, *runs(~_SPACE[b])) if len(b) else np.empty(0, dtype=np.uint64)


def windows_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` consecutive words (empty if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    base = np.uint64(_BASE)
    for j in range(k):
        out = out * base + words[j:j + n]
    return mix64(out)

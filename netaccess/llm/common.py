"""What the training-data operators share: written tables in the shared folder, words, text batches."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netaccess.operators.lineage import shared_folder

#: A word: a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
_LOWER = {c: c + 32 for c in range(65, 91)}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables as Parquet in the shared folder.

    A written table cuts lineage as a checkpoint does, survives the loss of any executor, is computed
    once, and has a known size, from which Spark decides on broadcasts. ``drop`` deletes early what no
    later plan reads; ``close`` the whole folder. What a lazy result still reads is deleted when the
    program ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/netaccess-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}
        atexit.register(self.close)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = path
        kept._scratch = self
        return kept

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            path = self.paths.pop(id(table), None)
            if path:
                _delete(self.spark, path)

    def close(self) -> None:
        atexit.unregister(self.close)
        if self.n and self.spark.sparkContext._jsc is not None:
            try:
                _delete(self.spark, self.root)
            except Exception as x:  # the session has ended before the program: the folder stays
                print(f"{self.root} is not deleted: {str(x)[:100]}")


def bounded_batches(df: DataFrame, rows: int = 1000) -> None:
    """Batches of texts go to Python workers in at most so many rows: texts are long, and a worker holds a batch whole.

    The session keeps the setting: a plan that is made now is executed later, and reads it then.
    """
    key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


#: Positions of the hash by which samples are chosen.
RANGE = 2**31


def place(*columns: Column) -> Column:
    """A position in 0 .. RANGE - 1 by hash."""
    return F.pmod(F.xxhash64(F.lit(3), *columns), F.lit(RANGE))


def cut_for(rows: DataFrame, column: Column, sample: int) -> int:
    """The hash position below which a quarter more than ``sample`` distinct values of ``column`` lie, about.

    One estimate of fixed size comes to the driver; distinct values count, so copies of one do not fill a sample.
    """
    n = rows.agg(F.approx_count_distinct(column, 0.02).alias("n")).first()["n"]
    return RANGE if n <= sample else int(1.25 * sample / n * RANGE)


def key_names(keys: Iterable[str], results: Iterable[str]) -> list[str]:
    """The names that key columns have in a result: one that is the name of a result column gets ``_in`` behind it."""
    taken = {r.lower() for r in results}
    return [f"{k}_in" if k.lower() in taken else k for k in keys]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(c: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def byte_words(text: str | None) -> list[bytes]:
    """The words, A-Z lower-cased, as UTF-8; bytes.split() cuts at exactly WORD's six characters."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def chunks(pdf: pd.DataFrame, column: str, chars: int = 1_000_000, rows: int = 256) -> Iterator[pd.DataFrame]:
    """Slices of a batch that hold at most so many rows and characters (one row at least): bounded work memory."""
    start = total = 0
    lengths = [0 if t is None else len(t) for t in pdf[column]]
    for i, n in enumerate(lengths):
        if i > start and (total + n > chars or i - start >= rows):
            yield pdf.iloc[start:i]
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield pdf.iloc[start:]

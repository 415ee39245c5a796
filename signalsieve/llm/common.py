"""What several operators of this package share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the ASCII controls 09 to 0D.
WHITE = r"[\x20\x09-\x0D]+"

#: Where a row's content lies.
LOCATOR = ["_file", "_row"]

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset in a local session, as in tests, one folder of this process, removed when it ends.
    """
    stated = spark.conf.get("spark.checkpoint.dir", None)
    if stated:
        return stated.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe from lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores in front until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def with_locator(docs: DataFrame, file: str = "_file", row: str = "_row") -> DataFrame:
    """``docs`` with the file and the row in it that hold each row's content.

    A frame that is not read straight from Parquet files is written to the shared folder first.
    """
    try:
        return docs.withColumns({file: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")})
    except AnalysisException:
        return with_locator(written(docs, "located"), file, row)


def located(docs: DataFrame, *wanted: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """``docs`` with locators under names of their own, the ``wanted`` columns of it with the
    locators as ``_file`` and ``_row``, and those own names."""
    names = fresh(docs, *LOCATOR)
    placed = with_locator(docs, *names)
    return placed, placed.select(*wanted, *(F.col(n).alias(c) for n, c in zip(names, LOCATOR))), names


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for each row."""
    return F.transform(F.array(value), use)[0]


def importable(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package from where the driver has it.

    On a cluster the package is installed or sent along; the entry then does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))


def full_text(text: Column | str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The words between white space, as an array."""
    return F.array_remove(F.split(text, WHITE, -1), "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

"""Immutable versions of a table: a Parquet folder of each version's rows and an entry in the manifest.

Writers need no lock. Rows are written to a folder of their own first; a
version exists from the moment its entry does, and an entry is only created if
there is none of its number yet. A writer that comes second reads the manifest
again and tries the next number, so no version is lost or overwritten.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from urllib.parse import urlparse
from urllib.request import url2pathname

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MANIFEST = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("label", T.StringType()),
    T.StructField("parent", T.IntegerType()), T.StructField("operation", T.StringType()),
    T.StructField("created", T.StringType()),
])
#: The entry also names the folder of the rows; entries without one have it by number.
ENTRY = T.StructType([*MANIFEST.fields, T.StructField("folder", T.StringType())])


def _manifest(root: str) -> str:
    return f"{root.rstrip('/')}/_manifest"


def _entries(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(ENTRY).json(_manifest(root))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # an unreadable manifest is no empty one
            raise
        return spark.createDataFrame([], ENTRY)


def _create(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file with this content if there is none; whether it was created.

    Distributed file systems refuse a second creation themselves. Their driver
    for local disks checks and creates in two steps, so a local entry is
    written aside and linked to its name, which fails if that is taken.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place.getParent())
    full = files.makeQualified(place).toString()
    if urlparse(full).scheme == "file":
        target = url2pathname(urlparse(full).path)
        aside = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        with open(aside, "w", encoding="utf-8") as file:
            file.write(content)
        try:
            os.link(aside, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(aside)
        return True
    try:
        out = files.create(place, False)
    except Py4JJavaError as e:
        if files.exists(place):
            return False
        raise e
    try:
        out.write(content.encode())
    finally:
        out.close()
    return True


def versions(spark: SparkSession, root: str, newest: int | None = None) -> DataFrame:
    """All manifest rows, newest first, or as many of them as the caller asks for."""
    rows = _entries(spark, root).select(*MANIFEST.names)
    ordered = rows.orderBy(F.col("version").desc())
    return ordered.limit(newest) if newest else ordered


def write_version(df: DataFrame, root: str, operation: str, parent: int | None = None) -> int:
    """Write the next version; its label extends the label of its parent (``1``, ``1.1``, ``1.1.1``).

    Any number of writers may do so at once. A writer that is lost before its
    entry is created leaves a folder that no version names.
    """
    spark = df.sparkSession

    def facts():
        found = _entries(spark, root).agg(
            F.max("version").alias("last"), F.max(F.when(F.col("version") == parent, F.col("label"))).alias("base"),
            F.count_if(F.col("parent").eqNullSafe(F.lit(parent))).alias("siblings"),
        ).first()
        if parent is not None and found["base"] is None:
            raise ValueError(f"no version {parent}")
        return found

    known = facts()
    folder = f"rows-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/{folder}")
    while True:
        number, place = (known["last"] or 0) + 1, known["siblings"] + 1
        label = str(place) if parent is None else f"{known['base']}.{place}"
        created = dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
        entry = dict(zip(ENTRY.names, (number, label, parent, operation, created, folder)))
        if _create(spark, f"{_manifest(root)}/v{number}.json", json.dumps(entry, ensure_ascii=False) + "\n"):
            return number
        known = facts()


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """One version, by default the newest."""
    entries = _entries(spark, root)
    row = entries.orderBy(F.col("version").desc()).first() if version is None else entries.filter(F.col("version") == version).first()
    if row is None:
        raise ValueError(f"no versions in {root}" if version is None else f"no version {version}")
    return spark.read.parquet(f"{root.rstrip('/')}/{row['folder'] or 'v' + str(row['version'])}")

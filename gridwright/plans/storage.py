"""Round trips through files and versions, written to the shared folder of the session."""

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.files import infer_and_cast, read_csv, read_json, write_table
from ..sources.versions import read_version, versions, write_version
from .dirt import CONTACTS, contacts
from .registry import query

#: Bytes of text that ``csv_split_texts`` writes into one file, which is one task's work: two default blocks.
FILE_BYTES = 256 << 20


def _fresh(t, name: str) -> str:
    return shared_folder(t.spark, f"gridwright-{name}-{uuid.uuid4().hex}")


@query(f"WITH {CONTACTS} SELECT c_custkey::DOUBLE AS c_custkey, c_name, birth, balance, points FROM contacts")
def csv_round_trip(t):
    """Written quoted, read as text, types inferred from whole columns."""
    path = _fresh(t, "csv")
    write_table(contacts(t).select("c_custkey", "c_name", "birth", "balance", "points"), path, "csv")
    return infer_and_cast(read_csv(t.spark, path))


@query("SELECT doc_id::VARCHAR AS doc_id, md5(text) AS digest FROM documents")
def csv_round_trip_texts(t):
    """Texts with quotes and line breaks survive."""
    path = _fresh(t, "texts")
    write_table(t.documents.select("doc_id", "text"), path, "csv")
    return read_csv(t.spark, path).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT doc_id::VARCHAR AS doc_id, lang, md5(text) AS digest FROM documents")
def csv_split_texts(t):
    """Texts with quotes and line breaks in one file for each ``FILE_BYTES`` of them, each read by as many tasks as it has blocks."""
    path = _fresh(t, "one-file")
    docs = t.documents.select("doc_id", "text", "lang")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    write_table(docs.repartition(max(1, -(-size // FILE_BYTES))), path, "csv")
    return read_csv(t.spark, path, split=True).select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM customer")
def json_round_trip(t):
    path = _fresh(t, "json")
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"))
    write_table(rows, path, "json")
    return read_json(t.spark, path, "c_custkey bigint, name string")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def version_round_trip(t):
    path = _fresh(t, "versions")
    rows = t.supplier.select("s_suppkey", "s_acctbal")
    first = write_version(rows, path, "load")
    second = write_version(read_version(t.spark, path, first).filter("s_acctbal > 0"), path, "filter", first)
    return read_version(t.spark, path, second)


@query("""WITH v AS (
    SELECT * FROM (VALUES (1, '1', NULL::INT, 'load'), (2, '1.1', 1, 'filter'), (3, '1.2', 1, 'sort'), (4, '1.1.1', 2, 'clean')) t(version, label, parent, operation)
    UNION ALL SELECT i, CAST(i - 3 AS VARCHAR), NULL::INT, 'load' FROM range(5, 26) r(i))
  SELECT version::INT AS version, label, parent, operation, (SELECT count(*) FROM region WHERE r_regionkey <> v.version % 7) AS n_rows FROM v""")
def version_labels(t):
    """Every one of 25 versions is listed, with the rows it has."""
    path = _fresh(t, "labels")
    rows = lambda v: t.region.filter(F.col("r_regionkey") != v % 7)
    a = write_version(rows(1), path, "load")
    b = write_version(rows(2), path, "filter", a)
    write_version(rows(3), path, "sort", a)
    write_version(rows(4), path, "clean", b)
    for v in range(5, 26):
        write_version(rows(v), path, "load")
    counts = [read_version(t.spark, path, v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n_rows")) for v in range(1, 26)]
    sizes = reduce(lambda x, y: x.unionByName(y), counts)
    return versions(t.spark, path).select("version", "label", "parent", "operation").join(sizes, "version")

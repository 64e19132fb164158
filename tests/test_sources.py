"""Files, workbooks, versions and streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from gridwright.functions import fx
from gridwright.operators.aggregates import aggregate
from gridwright.operators.cleaning import clean
from gridwright.operators.lookups import lookup
from gridwright.operators.ordering import sort_rows
from gridwright.operators.predicates import cond, filter_rows
from gridwright.operators.shaping import add_column, title_of
from gridwright.sources import infer_and_cast, read_csv, read_version, read_workbooks, versions, write_table, write_version
from gridwright.streaming import BatchOnly
from gridwright.streaming.rowwise import stream_folder, stream_steps, stream_to_folder


def test_csv_headers_and_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('订单 号,,1st,amount,day,empty\n"a""b\nc",x,1,2.5,2024-1-5,\n,y,2,3,2024/2/6,\n', encoding="utf8")
    df = infer_and_cast(read_csv(spark, str(path)))
    assert df.columns == ["订单_号", "列2", "_1st", "amount", "day", "empty"]
    assert [title_of(f) for f in df.schema.fields][:3] == ["订单 号", "列2", "1st"]
    assert [t for _, t in df.dtypes] == ["string", "string", "double", "double", "string", "string"]
    assert [r[0] for r in df.orderBy("_1st").collect()] == ['a"b\nc', None]


def test_json_keeps_nulls_and_titles(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    write_table(df, str(tmp_path / "j"), "json")
    assert '{"a":1,"b":null}' in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))


def test_versions(spark, tmp_path):
    root, df = str(tmp_path / "v"), spark.range(3)
    a = write_version(df, root, "load")
    b = write_version(df.filter("id > 0"), root, "filter", a)
    assert [r["label"] for r in versions(spark, root).collect()] == ["1.1", "1"]
    assert read_version(spark, root).count() == 2 and read_version(spark, root, a).count() == 3 and b == 2
    with pytest.raises(ValueError):
        write_version(df, root, "x", 9)


def workbook(path, sheets):
    """A minimal workbook: shared text, inline text, numbers and a missing cell."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {main}><sheets>" + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        shared = []
        for i, rows in enumerate(sheets.values()):
            body = ""
            for r, row in enumerate(rows, 1):
                cells = ""
                for c, v in enumerate(row):
                    ref = f"{chr(65 + c)}{r}"
                    if v is None:
                        continue
                    if isinstance(v, str) and v.startswith("!"):
                        cells += f'<c r="{ref}" t="inlineStr"><is><t>{v[1:]}</t></is></c>'
                    elif isinstance(v, str):
                        shared.append(v)
                        cells += f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
                    else:
                        cells += f'<c r="{ref}"><v>{v}</v></c>'
                body += f'<row r="{r}">{cells}</row>'
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"员工": [["姓名", "工资"], ["张三", 100], ["!李四", None]], "other": [["x"], [1.5]]})
    workbook(tmp_path / "b.xlsx", {"员工": [["姓名", "工资"], ["王五", 300]]})
    tables = read_workbooks(spark, str(tmp_path))
    assert sorted(tables) == ["other", "员工"]
    got = {(r["姓名"], r["工资"]) for r in tables["员工"].collect()}
    assert got == {("张三", "100"), ("李四", None), ("王五", "300")}


def test_workbooks_with_other_columns(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"s": [["name", "pay"], ["x", 1]]})
    workbook(tmp_path / "b.xlsx", {"s": [["pay", "name", "unit", None, "name"], [2, "y", "kg", "!loose", "z"], [None, "w"]]})
    table = read_workbooks(spark, str(tmp_path))["s"]
    assert [title_of(f) for f in table.schema.fields][2:] == ["name", "pay", "unit", "列4", "name"]
    got = sorted(tuple(r)[1:] for r in table.collect())
    assert got == [(1, "x", "1", None, None, None), (1, "y", "2", "kg", "loose", "z"), (2, "w", None, None, None, None)]


def test_row_local_steps_on_a_stream(spark, tmp_path):
    batch = spark.range(50).select("id", F.when(F.col("id") % 5 == 0, " ").otherwise(F.col("id").cast("string")).alias("n"))
    batch.write.parquet(str(tmp_path / "in"))
    names = spark.createDataFrame([(i, f"name {i}") for i in range(10)], "id bigint, name string")
    steps = [
        lambda d: clean(d, numeric=["n"], subset=["n"]),
        lambda d: filter_rows(d, [cond("n", "LT", 20)]),
        lambda d: add_column(d, "double", fx.multiply("n", F.lit(2))),
        lambda d: lookup(d, names, "id", ["name"]),
    ]
    stream = stream_folder(spark, str(tmp_path / "in"), batch.schema)
    query = stream_to_folder(stream_steps(stream, *steps), str(tmp_path / "out"), "rows", checkpoint=str(tmp_path / "progress"))
    assert query.awaitTermination(60)
    want = stream_steps(batch, *steps)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 16


def test_whole_table_operators_refuse_streams(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = stream_folder(spark, str(tmp_path / "in"), "id bigint")
    for op in (lambda: sort_rows(stream, [("id", True)]), lambda: aggregate(stream, [("id", "SUM")])):
        with pytest.raises(BatchOnly):
            op()


def test_concurrent_writers_lose_no_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "v")
    first = write_version(spark.range(1), root, "load")
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda n: write_version(spark.range(n), root, f"take {n}", first), range(2, 14)))
    assert sorted(numbers) == list(range(2, 14))
    listed = {r["version"]: (r["label"], r["operation"], r["parent"]) for r in versions(spark, root).collect()}
    assert sorted(label for label, *_ in listed.values()) == sorted(["1", *(f"1.{i}" for i in range(1, 13))])
    for n, number in zip(range(2, 14), numbers):
        assert listed[number][1:] == (f"take {n}", first) and read_version(spark, root, number).count() == n
    with pytest.raises(ValueError):
        read_version(spark, root, 99)


def test_versions_of_earlier_manifests_are_read(spark, tmp_path):
    root = str(tmp_path / "v")
    spark.range(5).write.parquet(f"{root}/v1")
    (tmp_path / "v" / "_manifest").mkdir()
    (tmp_path / "v" / "_manifest" / "part-0.json").write_text('{"version": 1, "label": "1", "operation": "load", "created": "2025-01-01"}')
    assert write_version(spark.range(2), root, "filter", 1) == 2
    assert [read_version(spark, root, v).count() for v in (1, 2)] == [5, 2]


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of a few bytes, so that every record crosses block ends somewhere."""
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


CELLS = ["plain", "", None, 'say "hi"', "two\nlines", '"', '\n', "a,b", 'x"\n\n"y', "é\n中文", " edge ", "long " * 40, "\n".join("line" for _ in range(30))]


@pytest.mark.parametrize("block", [7, 64, 500, 1 << 20])
def test_split_reading_equals_whole_files(spark, tmp_path, small_blocks, block):
    import random

    rng = random.Random(block)
    rows = [(i, rng.choice(CELLS), rng.choice(CELLS)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    write_table(df.repartition(3, "id"), f"{tmp_path}/t", "csv")
    whole = sorted(map(tuple, read_csv(spark, f"{tmp_path}/t").collect()), key=str)
    assert len(whole) == len(rows)
    small_blocks(block)
    out = read_csv(spark, f"{tmp_path}/t", split=True)
    assert out.columns == ["id", "a", "b"]
    assert sorted(map(tuple, out.collect()), key=str) == whole


def test_split_reading_of_plain_files(spark, tmp_path, small_blocks):
    """Line ends of both kinds, empty lines, short rows, no last line end, files with a header only."""
    (tmp_path / "a.csv").write_bytes(b'k,v\r\n1,x\r\n\r\n2,"y ""q"" z"\r\n3\r\n4,last')
    (tmp_path / "b.csv").write_bytes(b"k,v\n5,\n\n6,w\n")
    (tmp_path / "c.csv").write_bytes(b"k,v\n")
    small_blocks(5)
    want = {("1", "x"), ("2", 'y "q" z'), ("3", None), ("4", "last"), ("5", None), ("6", "w")}
    got = read_csv(spark, str(tmp_path), split=True)
    assert set(map(tuple, got.collect())) == want == set(map(tuple, read_csv(spark, str(tmp_path)).collect()))
    bare = read_csv(spark, str(tmp_path / "b.csv"), header=False, split=True)
    assert sorted(map(tuple, bare.collect()), key=str) == sorted([("k", "v"), ("5", None), ("6", "w")], key=str)
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path), split=True, sep=";")


def test_split_reading_uses_many_tasks(spark, tmp_path, small_blocks):
    write_table(spark.range(4000).selectExpr("id", "concat('a', chr(10), id) AS v").repartition(1), f"{tmp_path}/one", "csv")
    small_blocks(4096)
    out = read_csv(spark, f"{tmp_path}/one", split=True)
    assert out.rdd.getNumPartitions() >= 8 and read_csv(spark, f"{tmp_path}/one").rdd.getNumPartitions() == 1
    assert out.count() == 4000 and out.filter("v = concat('a', chr(10), id)").count() == 4000


def test_split_texts_are_written_by_as_many_tasks_as_they_need(spark, tmp_path, monkeypatch):
    """All texts went through the one task that wrote the one file."""
    from gridwright.plans import QUERIES, storage

    rows = [(i, f'say "{i}"\n' * 20 if i % 7 else None, "en") for i in range(200)] + [(3, "", None), (None, "x", "de")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    query = QUERIES["csv_split_texts"]
    one = query(spark, str(tmp_path))
    monkeypatch.setattr(storage, "FILE_BYTES", 8000)
    many = query(spark, str(tmp_path))
    assert len(one.inputFiles()) == 1 and len(many.inputFiles()) == -(-sum(len(r[1] or "") for r in rows) // 8000)
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect())) and many.count() == len(rows)

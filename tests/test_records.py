"""Records that span lines, cut out of many blocks at once, against Spark's one-task reader."""

import random

import pytest
from pyspark.sql import functions as F

from fiscora.sources.csv import read_csv_many
from fiscora.sources.records import stays_open


@pytest.fixture
def small_blocks(spark):
    """Files are cut every 6000 bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.minPartitionNum")


def whole(spark, path, encoding="UTF-8"):
    return spark.read.option("header", True).option("multiLine", True).option("encoding", encoding).csv(path)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def value(rng):
    """Plain, quoted, with commas and line ends, escaped and stray quotes."""
    kind = rng.randrange(9)
    word = "".join(rng.choice("abcde fé") for _ in range(rng.randrange(1, 9)))
    if kind < 3:
        return word
    if kind == 3:
        return f'{word}"{word}'
    if kind == 4:
        return f'"{word}, {word}"'
    if kind == 5:
        return f'"{word}\\"{word}\n{word}"'
    if kind == 6:
        return '"' + "\n".join([word] * rng.choice([2, 3, 60, 400])) + '"'
    if kind == 7:
        return f'"{word}\\\\"'
    return f'"\n\n{word},\n"'


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
def test_equals_the_one_task_reader(spark, tmp_path, small_blocks, end, encoding):
    rng = random.Random(4)
    lines = [f"{i},{value(rng)},{value(rng)},{i % 7}" for i in range(300)]
    lines[40:40] = [""] * 3
    path = tmp_path / "a.csv"
    path.write_bytes((end.join(["id,one,two,last", *lines]) + end).encode(encoding))
    got = read_csv_many(spark, [str(path)], encoding=encoding, lineage="file")
    columns = ["id", "one", "two", "last"]
    assert got.columns == [*columns, "file"]
    assert rows(got, *columns) == rows(whole(spark, str(path), encoding), *columns)
    assert got.filter(F.col("file").endswith("/a.csv")).count() == 300
    # More than one task found records.
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_unescaped_quotes_end_at_the_next_comma(spark, tmp_path, small_blocks):
    texts = ['"a ""b"" c",x', '"a" b,"x"', '"a""\nb",x', '"a"  ,"x\ny"', '"",""', '"""a""",x', 'a"b","c\n"']
    path = tmp_path / "q.csv"
    path.write_text("h,k\n" + "\n".join(texts * 200) + "\n")
    assert rows(read_csv_many(spark, [str(path)]), "h", "k") == rows(whole(spark, str(path)), "h", "k")


def test_headers_differ_and_files_are_empty(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('x,"long\nname"\n' + '1,"p\nq"\n' * 1500)
    (tmp_path / "b.csv").write_text('"long\nname",z\n' + '"r\ns",3\n' * 1500)
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("x\n")
    got = read_csv_many(spark, [str(tmp_path)])
    assert set(got.columns) == {"x", "z", "long\nname"}
    counts = {tuple(r)[:3]: r["n"] for r in got.groupBy("x", "long\nname", "z").agg(F.count("*").alias("n")).collect()}
    assert counts == {("1", "p\nq", None): 1500, (None, "r\ns", "3"): 1500}


def test_one_value_over_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f"line {i}" for i in range(4000))
    path = tmp_path / "a.csv"
    path.write_text(f'k,v\n1,a\n2,"{long}"\n3,b\n')
    assert {r["k"]: r["v"] for r in read_csv_many(spark, [str(path)]).collect()} == {"1": "a", "2": long, "3": "b"}


def test_state_of_a_line():
    assert not stays_open(b"a,b", False) and stays_open(b"a,b", True)
    assert stays_open(b'a,"b', False) and not stays_open(b'a"', True)
    assert not stays_open(b'5" pipe,6" pipe', False)
    assert stays_open(b'x\\"', True) and stays_open(b'x","y', True)
    assert not stays_open(b'x",', True) and not stays_open(b"", False) and stays_open(b"", True)

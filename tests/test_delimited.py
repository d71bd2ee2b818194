"""Quoted multi-line files read in splits equal Spark's own unsplit reader."""

import random

import pytest

from promptscreen.sources import delimited, io


def plain(spark, path, sep):
    return sorted((tuple(r) for r in spark.read.options(**io.CSV_OPTIONS).option("sep", sep).csv(path).collect()), key=str)


@pytest.fixture
def split_bytes(spark):
    """Reads files in splits of so many bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}

    def put(size):
        for n, v in names.items():
            spark.conf.set(n, v or str(size))

    yield put
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


VALUES = ["", "a", "two words", 'say "hi"', "line\nbreak", "crlf\r\nin", '"', '""', '"\n"', "tab\there", "comma, here", "\n\n", "é 東京 🙂",
          'x" y', "ends with\n", "\nstarts", "a\n\"b\"\nc", "long " * 40]


@pytest.mark.parametrize("sep,ends", [("\t", "\n"), (",", "\n"), ("\t", "\r\n")])
def test_written_files_of_any_split(spark, tmp_path, split_bytes, sep, ends):
    rng = random.Random(len(sep + ends))
    rows = [(str(i), *(rng.choice(VALUES) for _ in range(3))) for i in range(60)]

    def quoted(v):
        return '"' + v.replace('"', '""') + '"' if any(c in v for c in f'"\r\n{sep}') or not v else v

    text = ends.join(sep.join(map(quoted, r)) for r in [("prompt_id", "a", "b", "c"), *rows]) + ends
    path = str(tmp_path / "one.tsv")
    open(path, "w", newline="").write(text)
    want = plain(spark, path, sep)
    assert len(want) == 60
    for size in (41, 333, 10**6):
        split_bytes(size)
        got = delimited.read(spark, path, io.CSV_OPTIONS, sep)
        assert got.columns == ["prompt_id", "a", "b", "c"]
        found = [tuple(r) for r in got.collect()]
        if ends == "\r\n":                                 # Spark's reader changes line breaks inside values here
            assert any(v and "\r\n" in v for r in found for v in r)
            found = [tuple(v and v.replace("\r\n", "\n") for v in r) for r in found]
        assert sorted(found, key=str) == want, size
        if size == 41:
            lines = spark.read.option("lineSep", "\n").text(path)
            assert lines.rdd.getNumPartitions() > 40          # one file, many tasks


def test_odd_quotes(spark, tmp_path, split_bytes):
    lines = ['id\tv', '1\t5" wide', '2\t"a"tail', '3\tmid"dle"', '4\t"x""y"', '5\t', '', '6\t""', '7\t"open', 'still\topen"', '8\tlast']
    path = str(tmp_path / "odd.tsv")
    open(path, "w").write("\n".join(lines))
    want = plain(spark, path, "\t")
    for size in (9, 10**6):
        split_bytes(size)
        assert sorted((tuple(r) for r in delimited.read(spark, path, io.CSV_OPTIONS, "\t").collect()), key=str) == want
    assert ("7", "open\nstill\topen") in want


def test_folders_headers_and_empty_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "vanilla_benign", f'q "{i}"\nx', None if i % 2 else "y") for i in range(50)],
                               "prompt_id long, data_type string, vanilla string, adversarial string").repartition(5)
    io.write_raw(df, str(tmp_path / "raw.tsv"))
    back = io.read_raw(spark, str(tmp_path / "raw.tsv"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    same = io.read_raw(spark, str(tmp_path / "raw.tsv"), columns=tuple(df.columns))
    assert same.count() == 50
    with pytest.raises(ValueError, match="header"):
        io.read_raw(spark, str(tmp_path / "raw.tsv"), columns=("prompt_id", "vanilla"))
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "two" / "b.csv").write_text("x,z\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        delimited.read(spark, str(tmp_path / "two"), io.CSV_OPTIONS, ",")
    (tmp_path / "head.csv").write_text("x,y\n")
    only = delimited.read(spark, str(tmp_path / "head.csv"), io.CSV_OPTIONS, ",")
    assert only.columns == ["x", "y"] and only.count() == 0

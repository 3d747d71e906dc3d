import csv
import random

import pytest

from condeval.sources import split_csv as C
from condeval.sources import tables as S

SCHEMA = S.columns(n="long", text="string", ratio="double", flag="boolean")


@pytest.fixture
def small_pieces(spark):
    """Splits of a few hundred bytes, so that borders fall everywhere in records."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def set_to(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield set_to
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def write(path, rows, seed, end="\n"):
    pick = random.Random(seed)
    pool = ["a", "b,", '"', '""', "\n", "\n\n", ",", "é", " ", 'x"y', "NA", "\r", '",\n"', "汉字"]
    with open(path, "w", encoding="utf-8", newline="") as file:
        out = csv.writer(file, lineterminator=end)
        out.writerow(SCHEMA.names)
        for n in range(rows):
            text = "".join(pick.choice(pool) for _ in range(pick.choice([0, 1, 5, 40])))
            out.writerow([n, text, pick.choice(["", 0.5, -3]), pick.choice(["true", "", "false"])])


@pytest.mark.parametrize("size, end", [(200, "\n"), (777, "\n"), (64, "\n"), (300, "\r\n"), (1 << 20, "\n")])
def test_equal_to_the_multi_line_reader(spark, tmp_path, small_pieces, size, end):
    path = str(tmp_path / "t.csv")
    write(path, 400, size, end)
    want = sorted(map(str, S.read_csv_table(spark, path, SCHEMA).collect()))
    small_pieces(size)
    got = C.read_split_csv(spark, path, SCHEMA)
    assert sorted(map(str, got.collect())) == want and len(want) == 400
    tasks = C._lines(spark, path).rdd.getNumPartitions()
    assert tasks >= 8 or size > 1000


def test_a_record_over_many_pieces(spark, tmp_path, small_pieces):
    path = tmp_path / "t.csv"
    long = "line, with \"\"quotes\"\"\n" * 300
    path.write_text(f'n,text,ratio,flag\n1,"{long}",0.5,true\n2,b,,\n\n3,"c\nd",1,false')
    small_pieces(100)
    rows = {r["n"]: r for r in C.read_split_csv(spark, str(path), SCHEMA).collect()}
    assert rows[1]["text"] == long.replace('""', '"') and rows[2]["ratio"] is None and rows[3]["text"] == "c\nd" and len(rows) == 3


def test_a_folder_of_files_and_none(spark, tmp_path, small_pieces):
    small_pieces(150)
    for n in range(3):
        write(str(tmp_path / f"{n}.csv"), 40, n)
    assert C.read_split_csv(spark, str(tmp_path), SCHEMA).count() == 120
    with pytest.raises(FileNotFoundError, match="absent"):
        C.read_split_csv(spark, str(tmp_path / "absent"), SCHEMA)


def test_header_and_malformed_records(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("n,other,ratio,flag\n1,a,0.5,true\n")
    with pytest.raises(Exception, match="header does not conform"):
        C.read_split_csv(spark, str(path), SCHEMA).collect()
    path.write_text("n,text,ratio,flag\nx,a,0.5,true\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        C.read_split_csv(spark, str(path), SCHEMA).collect()

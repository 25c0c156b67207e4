import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from shellac import sources
from shellac.schema import SOURCE_FIELDS
from shellac.sources import quoted_lines


def by_hand(data: str) -> list[tuple]:
    rows = list(csv.reader(io.StringIO(data, newline="")))[1:]
    rows = [[v.strip() or None for v in r[: len(SOURCE_FIELDS)]] for r in rows]
    return [tuple((r + [None] * 3)[:3]) for r in rows if any(r)]


def made(r: random.Random, rows: int, values: list[str]) -> str:
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=r.choice(["\n", "\r\n"]))
    w.writerow(["Artist\nname", 'the "Credit"', "Title"])
    for _ in range(rows):
        w.writerow([r.choice(values) for _ in range(r.randint(1, 3))])
    return out.getvalue()


VALUES = ["a", "", "two\nlines", 'say ""', '"', '7" single', "x,y", '\n', 'é"\n,"', "\n\n\n", '","', "long " * 30 + "\nend"]


@pytest.mark.parametrize("split", [40, 64, 200, 1 << 20])
def test_every_split_finds_its_state(spark, tmp_path, split):
    r = random.Random(split)
    texts = [made(r, n, VALUES) for n in (18, 1, 0, 8)]
    for k, t in enumerate(texts):
        (tmp_path / f"{k}.csv").write_bytes((b"\xef\xbb\xbf" if k == 1 else b"") + t.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sources.read_catalogue_csv(spark, str(tmp_path / "*.csv")).select("n", *SOURCE_FIELDS[:3]).orderBy("n").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r["n"] for r in got] == list(range(1, len(got) + 1))
    assert [tuple(r)[1:] for r in got] == [row for t in texts for row in by_hand(t)]


def test_quotes_that_open_no_field_are_signs(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'A,B,C\n7" single,x,y\nz,"in\r\ntwo",w\n\n"12"" mix",5" ,\n')
    got = [tuple(r)[:3] for r in sources.read_catalogue_csv(spark, str(tmp_path)).orderBy("n").select(*SOURCE_FIELDS[:3]).collect()]
    assert got == [('7" single', "x", "y"), ("z", "in\r\ntwo", "w"), ('12" mix', '5"', None)]


def test_one_byte_encodings_need_no_option(spark, tmp_path):
    spark.conf.unset("spark.sql.legacy.javaCharsets")
    (tmp_path / "a.csv").write_bytes('A,B\n"Ané\n",€\nb\x81c,\n'.encode("latin-1", "replace").replace(b"?", b"\x80"))
    got = [tuple(r)[:2] for r in sources.read_catalogue_csv(spark, str(tmp_path), "windows-1252").orderBy("n").select(*SOURCE_FIELDS[:2]).collect()]
    assert got == [("Ané", "€"), ("b�c", None)]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"


def test_empty_files_and_open_values(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    assert sources.read_catalogue_csv(spark, str(tmp_path)).count() == 0
    (tmp_path / "b.csv").write_bytes(b'A\n1\n"never closed\n2\n')
    got = [r[0] for r in sources.read_catalogue_csv(spark, str(tmp_path)).orderBy("n").select(SOURCE_FIELDS[0]).collect()]
    assert got[0] == "1" and len(got) == 2


def test_lines_left_open_as_an_expression(spark):
    r = random.Random(3)
    lines = ["".join(r.choice('",a"') for _ in range(r.randint(0, 9))) for _ in range(600)] + ['\ufeff"a', '"a""', "", '7","open']
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", quoted_lines.left_open(F.col("line")).alias("open")).collect()
    assert all(x["open"] == quoted_lines.ends_inside(x["line"], False) for x in got) and len(got) == len(lines)
    assert 50 < sum(x["open"] for x in got) < 500


def test_states_of_a_line():
    ends = quoted_lines.ends_inside
    assert [ends(x, False) for x in ("a,b", 'a,"b', '"a""', '"a"""', 'a"b', '"a","b', '"a",b"')] == [False, True, True, False, False, True, False]
    assert [ends(x, True) for x in ("a,b", 'a"', 'a""', 'a","', 'a",b"', '"')] == [True, False, True, True, False, False]

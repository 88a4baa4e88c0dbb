"""CSV files read in ranges, headers for each file, and first lines."""

import csv
import io
import random

import pytest

from veilwright.operators import watermark as wm
from veilwright.sources import records
from veilwright.sources.tables import read_csv
from veilwright.sources.watermarked import read_watermarked, watermarks

SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
MARK = wm.PREFIX + ' {"anonymized": true, "note":"a,\\"b","c":"d"}'
PARTS = ["a", "b", '"', ",", "\n", "é", " ", '""', "\n\n", 'x"y', "\r\n", "#"]


@pytest.fixture
def small_ranges(spark):
    before = [spark.conf.get(k) for k in SIZES]

    def use(size):
        for key in SIZES:
            spark.conf.set(key, str(size))

    yield use
    for key, value in zip(SIZES, before):
        spark.conf.set(key, value)


def table_of(seed, n, longest=60):
    draw = random.Random(seed)
    rows = [("k%d" % i, "".join(draw.choice(PARTS) for _ in range(draw.randint(0, longest))), "n%d" % i) for i in range(n)]
    rows[n // 2] = ("k%d" % (n // 2), "\n".join("z" * 90 for _ in range(100)), "across ranges")
    return rows


def write(path, rows, order=(0, 1, 2), mark=None):
    with open(path, "w", newline="", encoding="utf-8") as file:
        if mark:
            file.write(mark + "\n")
        out = csv.writer(file, lineterminator="\n")
        out.writerow([("key", "text", "name")[i] for i in order])
        for row in rows:
            out.writerow([row[i] for i in order])


@pytest.mark.parametrize("size", [700, 2500, 40_000])
def test_ranges_give_the_rows_of_the_file(spark, tmp_path, small_ranges, size):
    rows = table_of(size, 400)
    write(tmp_path / "a.csv", rows)
    small_ranges(size)
    df = read_csv(spark, str(tmp_path / "a.csv"), "key string, text string, name string", na_tokens=[], place=True)
    got = sorted((tuple(r) for r in df.collect()), key=lambda r: r[-1])
    assert [r[:3] for r in got] == rows
    assert df.rdd.getNumPartitions() > 2 or size > 30_000


def test_ranges_of_files_of_many_sizes(spark, tmp_path, small_ranges):
    """The size of ranges depends on all files of a scan; no scan may leave some of them out."""
    rows = table_of(8, 900)
    edges = [0, 1, 2, 3, 5, 8, 9, 10, 500, 520, 900]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        write(tmp_path / f"{i:02d}.csv", rows[a:b], (0, 1, 2) if i % 2 else (2, 1, 0))
    small_ranges(100)
    spark.conf.set(SIZES[0], "1000000")  # so that ranges are cut by the bytes for each core
    df = read_csv(spark, str(tmp_path), "key string, text string, name string", na_tokens=[], place=True)
    assert [tuple(r)[:3] for r in df.orderBy(records.PLACE).collect()] == rows
    assert df.count() == 900


def test_each_file_has_its_own_header(spark, tmp_path, small_ranges):
    rows = table_of(5, 300)
    write(tmp_path / "a.csv", rows[:100], (0, 1, 2), MARK)
    write(tmp_path / "b.csv", rows[100:220], (2, 0, 1))
    write(tmp_path / "c.csv", rows[220:], (1, 2, 0), MARK)
    (tmp_path / "d.csv").write_text("")
    small_ranges(1500)
    df = read_watermarked(spark, str(tmp_path), na_tokens=[], place=True)
    assert [tuple(r)[:3] for r in df.orderBy(records.PLACE).collect()] == rows


def test_other_columns_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("a,c\n1,2\n")
    with pytest.raises(records.HeaderMismatch, match="not expected .'c'.*missing .'b'"):
        read_csv(spark, str(tmp_path))
    with pytest.raises(records.HeaderMismatch, match="missing .'x'"):
        read_csv(spark, str(tmp_path / "a.csv"), "a int, b int, x int")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        read_csv(spark, str(tmp_path / "none"))


def test_odd_files(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes(b'\xef\xbb\xbf"a",b,b,\n1,2,3,4\n\n5,6,7,8\n')
    df = read_csv(spark, str(tmp_path / "bom.csv"))
    assert df.columns == ["a", "b", "b.1", "Unnamed: 3"] and df.count() == 2
    (tmp_path / "middle.csv").write_text('a,b\n5" pipe,"x"\n"q",z"z\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "middle.csv")).collect()] == [('5" pipe', "x"), ("q", 'z"z')]
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(Exception, match="a quote stays open"):
        read_csv(spark, str(tmp_path / "open.csv")).collect()
    (tmp_path / "long.csv").write_text('a,b,c\n1,"' + "a," * 500_000 + '"\n2,x,y\n')
    assert [(r.a, len(r.b), r.c) for r in read_csv(spark, str(tmp_path / "long.csv")).collect()] == [(1, 1_000_000, None), (2, 1, "y")]
    (tmp_path / "only.csv").write_text("a\n")
    assert read_csv(spark, str(tmp_path / "only.csv")).count() == 0
    (tmp_path / "bytes.csv").write_bytes(b"a,b\n1,\xff\n")
    assert read_csv(spark, str(tmp_path / "bytes.csv")).first()["b"] == "�"


def test_an_open_quote_in_a_cut_file_raises(spark, tmp_path, small_ranges):
    (tmp_path / "open.csv").write_text("a,b\n" + "1,x\n" * 2000 + '2,"y\n' + "3,z\n" * 2000)
    small_ranges(3000)
    with pytest.raises(Exception, match="a quote stays open"):
        read_csv(spark, str(tmp_path / "open.csv")).collect()


def test_ranges_that_change_between_plan_and_read_raise(spark, tmp_path, small_ranges):
    write(tmp_path / "a.csv", table_of(9, 400))
    small_ranges(3000)
    df = read_csv(spark, str(tmp_path / "a.csv"), "key string, text string, name string")
    small_ranges(1000)
    with pytest.raises(Exception, match="read them again"):
        df.collect()


def test_quotes_follow_the_csv_module():
    draw = random.Random(11)
    for _ in range(500):
        text = "".join(draw.choice(['a', '"', ",", "\n", '""']) for _ in range(30)) + "\n"
        data = text.encode()
        quotes = records.Quotes()
        _, last = quotes.feed(data)
        closed = data[: max(last, 0)].decode()
        rows = list(csv.reader(io.StringIO(closed, newline="")))
        more = list(csv.reader(io.StringIO(closed + "mark\n", newline="")))
        assert more[: len(rows)] == rows and more[-1] == ["mark"], text
        halves = records.Quotes()  # lines fed one by one end the same way
        for line in data.splitlines(keepends=True):
            halves.feed(line)
        assert halves.inside == quotes.inside


def test_both_parsers_agree():
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(table_of(3, 200))
    data = out.getvalue().encode()
    assert [c.to_pylist() for c in records.parse_cells(data, 3)] == [c.to_pylist() for c in records._parse_rows(data, 3)]


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


@pytest.mark.parametrize("lead", [MARK + "\n", "", "\ufeff"])
def test_heads_take_no_more_than_they_need(lead):
    for rows in (0, 10, 200_000):
        file = Counted((lead + 'key,"te\nxt"\n' + "1,some text\n" * rows).encode())
        mark, header = records.head_of(file, wm.PREFIX.encode(), True)
        assert header == b'key,"te\nxt"\n' and (mark is not None) == (lead.startswith("#"))
        assert file.taken <= 2 * records.BLOCK
    assert records.head_of(Counted(b""), b"#", True) == (None, None)
    assert records.head_of(Counted(b"a,b"), b"#", True) == (None, b"a,b\n")
    long = Counted(b"x" * 10_000_000)
    assert records.head_of(long, wm.PREFIX.encode(), False) == (None, None) and long.taken == records.BLOCK
    names = b",".join(b"column%d" % i for i in range(20_000)) + b"\n"
    assert records.head_of(Counted(names + b"1,2\n"), b"", True) == (None, names)


def test_marks_of_large_files_are_found_without_reading_them(spark, tmp_path):
    (tmp_path / "a.csv").write_text(MARK + "\nkey,text\n" + "1,some text here\n" * 1_000_000)
    store = spark.sparkContext._jsc.sc().statusStore()

    def taken():
        executors = store.executorList(False)
        return sum(executors.apply(i).totalInputBytes() for i in range(executors.size()))

    before = taken()
    assert watermarks(spark, str(tmp_path)).first()["is_watermarked"]
    assert taken() - before < 1_000_000


def test_heads_by_sparks_own_reader(spark, tmp_path, monkeypatch):
    for i in range(5):
        write(tmp_path / f"{i}.csv", table_of(i, 40), (0, 1, 2), MARK if i % 2 else None)
    path = str(tmp_path)
    want = sorted(map(tuple, records.file_heads(spark, path, wm.PREFIX).collect()))
    files = [r[0] for r in want]
    monkeypatch.setattr(records, "FILES_AT_ONCE", 2)
    assert sorted(map(tuple, records._limited_head(spark, files, wm.PREFIX.encode()).collect())) == want


@pytest.mark.parametrize(
    "body, marked, reason",
    [
        ("{'anonymized': true}", False, wm.NOT_AN_OBJECT),
        ('{"anonymized": true} x', False, wm.NOT_AN_OBJECT),
        ("1], [2", False, wm.NOT_AN_OBJECT),
        ("[1, 2]", True, wm.NOT_AN_OBJECT),
        ("{}", True, wm.MISSING + "anonymized"),
        ('{"anonymized": 0.0, "anonymization_timestamp": 1, "anonymization_params": 1, "version": 1}', True, wm.NOT_ANONYMIZED),
        ('{"anonymized": "0", "anonymization_timestamp": 1, "anonymization_params": 1, "version": 1}', True, wm.VALID),
        ("  ", False, wm.NOT_AN_OBJECT),
    ],
)
def test_only_strict_json_is_a_mark(spark, body, marked, reason):
    lines = spark.createDataFrame([(f"{wm.PREFIX} {body}",)], "line string")
    found = wm.validate_watermark(wm.detect_watermark(lines)).first()
    assert (found["is_watermarked"], found["reason"]) == (marked, reason)


def test_long_lines_are_fed_in_bounded_parts():
    lines = [b"k%d," % i + b"a" * (i * 90_000) for i in range(40)] + [b"", b"x" * 5_000_000, b"y"]
    batch = records.pa.RecordBatch.from_pydict(
        {"file_key": [1] * 20 + [2] * (len(lines) - 20), "start": [0] * len(lines), "value": records.pa.array(lines, records.pa.binary())}
    )
    runs = [(of["file_key"], part) for of, part in records._runs(iter([batch]))]
    assert [line for _, part in runs for line in part] == lines
    assert [key for key, part in runs for _ in part] == batch.column("file_key").to_pylist()
    assert all(len(part) == 1 or sum(map(len, part)) <= 1 << 21 for _, part in runs)

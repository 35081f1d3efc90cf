"""CSV by record against Python's csv module and literals."""

import csv
import io
import random

import pytest

from tickvet.sources import IngestError, read_csv
from tickvet.sources.csv_records import lines, read_csv_files, records, splits_of
from tickvet.shared import written

HEAD = "date,open,high,low,close"
ROW = "2024-01-02,100,101,99,100.5"


@pytest.mark.parametrize("split", ["134217728", "64"])
def test_records_as_the_csv_module_reads_them(spark, tmp_path, split):
    rng, want = random.Random(5), {}
    for name in "abc":
        rows = [["date", "open", "note", "high", "low", "close"]]
        for i in range(120):
            note = "".join(rng.choice(['"', ",", "\n", "x", " y", '""', "\n\n", "é"]) for _ in range(rng.choice([0, 1, 4, 40])))
            rows.append([f"2024-01-{i % 28 + 1:02d}", str(i), note, str(i + 1), str(i - 1), str(i + 0.5)])
        out = io.StringIO()
        csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"])).writerows(rows)
        (tmp_path / f"{name}.csv").write_text(out.getvalue(), newline="")
        want[name] = rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        numbered = written(lines(spark, f"file://{tmp_path}"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    parts = splits_of(numbered)
    assert parts.count() == 3 if len(split) > 3 else parts.filter("from_inside").count() > 10
    got = {}
    for r in records(numbered, parts).orderBy("record").collect():
        got.setdefault(r.file[-5], []).append((r.record, next(csv.reader(io.StringIO(r.value, newline="")))))
    assert got == {k: list(enumerate(rows, 1)) for k, rows in want.items()}


def test_many_files(spark, tmp_path):
    texts = {
        "plain": f"{HEAD}\n{ROW}\n\n   \n{ROW}",
        "names": '﻿"Time" ,O,H,L,C,VOL,date\r\n1704153600,1,2,0.5,"1.5",7,\r\n20240103,1,2,0.5,x,,2024-01-04\r\n',
        "quoted": f'note,{HEAD}\n"a ""b"", c\n\n{ROW}",{ROW}\n"","",1,2,3,4\n',
        "short": "date,open,close\n1,2,3\n",
        "bare": HEAD + "\n\n",
        "blank": "\n  \n",
        "empty": "",
        "open": f'{HEAD}\n{ROW}\n"{ROW}\n{ROW}\n',
        "ragged": "\n".join([HEAD, *[ROW] * 8, "2024-01-03,1", ROW + ",more"]),
        "lax": "\n".join([HEAD, *[ROW] * 9, "2024-01-03,1"]),
    }
    for k, v in texts.items():
        (tmp_path / f"{k}.csv").write_text(v, newline="")
    from pyspark.sql import functions as F

    name = F.regexp_extract("file", r"(\w+)\.csv$", 1)
    t, errors = read_csv_files(spark, f"file://{tmp_path}", symbol=F.upper(name), dataset_id=name)
    assert {r.dataset_id: r.error for r in errors.collect()} == {
        "short": "missing columns: high, low; found: date, open, close", "bare": "the file has no rows", "blank": "the file has no header", "open": "a quote is never closed",
        "ragged": "2 of 10 rows have a different number of fields, first rows 9, 10",
    }
    assert {(r.dataset_id, r.symbol, r.source) for r in t.datasets.collect()} == {(k, k.upper(), "csv") for k in ("plain", "names", "quoted", "lax")}
    bars = {}
    for b in t.bars.orderBy("seq").collect():
        bars.setdefault(b.dataset_id, []).append((b.seq, b.ts_raw, b.open, b.close, b.volume))
    assert bars["plain"] == [(0, "2024-01-02", 100, 100.5, None), (1, "2024-01-02", 100, 100.5, None)]
    assert bars["names"] == [(0, "2024-01-02", 1, 1.5, 7), (1, "2024-01-04", 1, None, None)]
    assert bars["quoted"] == [(0, "2024-01-02", 100, 100.5, None), (1, None, 1, 4, None)]
    assert len(bars["lax"]) == 10 and bars["lax"][9] == (9, "2024-01-03", 1, None, None) and set(bars) == {"plain", "names", "quoted", "lax"}
    for k, why in {"short": "high, low", "empty": "no header", "open": "never closed"}.items():
        with pytest.raises(IngestError, match=why):
            read_csv(spark, f"file://{tmp_path}/{k}.csv")

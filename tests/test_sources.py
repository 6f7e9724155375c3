"""Growing files, numbered lines, states and archive cursors."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.plans.scratch import Scratch
from spanloom.sources import jsonl as J
from spanloom.sources import retry as R
from spanloom.sources import tail as T
from spanloom.sources.state import read_state, write_state
from spanloom.streaming import archive as A


@pytest.mark.parametrize("size", [64_000_000, 40])
def test_tail_of_a_growing_file(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(T, "RANGE", size)
    file, out, state = tmp_path / "in.jsonl", str(tmp_path / "out"), str(tmp_path / "state.json")
    line = lambda k, v: json.dumps({"k": k, "v": v}, ensure_ascii=False) + "\n"
    take = lambda: T.ingest_tail(spark, str(file), "k string, v string", ["k"], out, state)
    content = lambda: sorted((r["k"], r["v"]) for r in T.upserted(spark, out, "k string, v string", ["k"]).collect())
    cut = line("c", "später")
    file.write_text(line("a", "1") + line("b", "1") + "broken {\n" + line("a", "2") + cut[:9], encoding="utf-8")
    assert take() == 2 and content() == [("a", "2"), ("b", "1")]
    assert read_state(spark, state)["offsets"] != {} and take() == 0
    with file.open("a", encoding="utf-8") as f:
        f.write(cut[9:] + line("b", "3") + "\n" + line("d", "é" * 50))
    assert take() == 3 and content() == [("a", "2"), ("b", "3"), ("c", "später"), ("d", "é" * 50)]
    # a shorter file was replaced
    file.write_text(line("e", "1"), encoding="utf-8")
    assert take() == 1 and ("e", "1") in content()


def test_physical_line_numbers(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"part-{i}.txt").write_text("".join(f"{i}:{j} {'x' * (j % 50)}\n" for j in range(300)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r["line"]: r["value"].split()[0] for r in J.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i * 300 + j: f"{i}:{j}" for i in range(5) for j in range(300)}


def test_row_numbers_over_all_tasks(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.lit("x").alias("n"))
    got = sorted((r["k"], r["i"]) for r in J.numbered(df, ["k"], "i", Scratch(spark, "t")).collect())
    assert got == [(k, k + 1) for k in range(500)]
    assert J.numbered(df.limit(0), ["k"], "i", Scratch(spark, "t")).count() == 0


def test_states_are_replaced(spark, tmp_path):
    path = str(tmp_path / "deep" / "state.json")
    assert read_state(spark, path) == {}
    for v in (1, 2):
        write_state(spark, path, {"v": v, "ids": ["é"]})
    assert read_state(spark, path) == {"v": 2, "ids": ["é"]}
    assert [p.name for p in (tmp_path / "deep").iterdir() if not p.name.startswith(".")] == ["state.json"]


@pytest.mark.parametrize("most", [None, 1, 3])
def test_archive_cursor(spark, tmp_path, most):
    rows = [(f"i{n:02}", t) for n, t in enumerate([5, 5, 6, 6, 6, 6, 6, 7, 9, 9])] + [("none", None), (None, 6), ("old", 2)]
    df = spark.createDataFrame(rows, "id string, ts bigint")
    out, state = str(tmp_path / "out"), str(tmp_path / "state.json")
    taken = lambda: sorted(r["id"] for r in A.ingested(spark, out, df.schema).collect())
    # the archive shows a part of second 6 first
    early = df.where("ts < 6 or id in ('i02', 'i03')")
    c = A.ingest(early, state, out, "id", "ts", start=5, most=most, pages=1 if most is None else 4 // most + (4 % most > 0))
    assert c.after == 6 and not c.complete and set(c.boundary) == {"i02", "i03"} and taken() == ["i00", "i01", "i02", "i03"]
    c = A.ingest(df, state, out, "id", "ts", start=5, most=most)
    assert c.complete and c.total == 10 and c.after == 9 and set(c.boundary) == {"i08", "i09"}
    assert taken() == [f"i{n:02}" for n in range(10)]
    # a complete ingest is left alone
    assert A.ingest(df, state, out, "id", "ts", start=5) == c


def test_retries():
    def script(*answers):
        left = list(answers)

        def fetch():
            a = left.pop(0)
            if isinstance(a, Exception):
                raise a
            return a

        return fetch

    waits = []
    ok = (200, '{"a": 1}')
    assert R.get_json(script((503, ""), OSError(), (200, "{"), (429, ""), ok), sleep=waits.append) == {"a": 1} and waits == [2, 4, 3, 16]
    assert R.get_json(script((404, ""), ok), sleep=waits.append) is None
    waits.clear()
    assert R.get_json(script(*[(500, "")] * 9), R.Policy(attempts=8), waits.append) is None and waits == [2, 4, 8, 16, 32, 64, 120, 120]
    waits.clear()
    assert R.get_json(script(*[OSError()] * 9), R.CHAT, waits.append) is None and waits == [1, 2, 4, 8, 16]

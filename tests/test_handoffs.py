"""Hand-offs, ledgers and recordings: what is whole is read, what is not is an error."""

import uuid

import pytest

from windrow.operators import contracts
from windrow.sources import tables
from windrow.sources.scratch import shared_folder


def test_a_handoff_knows_its_version_rows_and_columns(spark):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    a = spark.createDataFrame([(1, "x|y", None), (2, "x", "y"), (2, "x", "y")], "k int, s string, t string")
    contracts.export({"a": a, "none": a.limit(0)}, path, 2)
    got = contracts.load(spark, path, 2)
    assert sorted(map(tuple, got["a"].collect()), key=str) == sorted(map(tuple, a.collect()), key=str) and got["none"].count() == 0
    with pytest.raises(ValueError, match="version 2, not 1"):
        contracts.load(spark, path)
    seal = lambda rows, kind="k int, s string, t string": contracts.seal({"a": spark.createDataFrame(rows, kind)}, 1).first()["digest"]
    # order and partitions do not matter; a null is not an empty text, a separator is no separator, a repeated row counts
    assert seal([(1, "a", "b"), (2, "c", None)]) == seal([(2, "c", None), (1, "a", "b")])
    assert len({seal([(1, "a", None)]), seal([(1, "a", "")]), seal([(1, "a|", "")]), seal([(1, "a", "|")]), seal([(1, "a", None)] * 2)}) == 5
    a.limit(2).write.mode("overwrite").parquet(f"{path}/a")
    with pytest.raises(ValueError, match="differ"):
        contracts.load(spark, path, 2)
    a.withColumnRenamed("t", "u").write.mode("overwrite").parquet(f"{path}/a")
    with pytest.raises(ValueError, match="differ"):
        contracts.load(spark, path, 2)


def test_ledger_keys_are_there_and_once(spark):
    ledger = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (3, 31)], "k int, position int")
    ask = lambda *k: contracts.looked_up(spark.createDataFrame([(i,) for i in k], "k int"), ledger, ["k"], "position").collect()
    assert sorted(map(tuple, ask(2, 1, 2))) == [(1, 10), (2, 20), (2, 20)]
    for k, why in ((7, "not in the ledger"), (3, "twice")):
        with pytest.raises(Exception, match=why):
            ask(1, k)


@pytest.mark.parametrize("lines, why", [(["0;1.5;1", "1;2;0", "2;3;1"], None), (["0;1;1", "2;2;0", "2;3;1"], "does not grow"), (["0;1;1", "1;2;2"], "not 0 or 1"), (["0;1;1", "1;2"], "MALFORMED"), (["0;1;1", "1;x;0"], "MALFORMED")])
def test_recordings_are_checked(spark, tmp_path, lines, why):
    (tmp_path / "r.csv").write_text("\n".join(["t;value;flag", *lines]))
    read = tables.recording(spark, f"file://{tmp_path}/r.csv", "t long, value double, flag int", "t", ("flag",), None if why != "MALFORMED" else ";")
    if why is None:
        assert [r["t"] for r in read.collect()] == [0, 1, 2]
    else:
        with pytest.raises(Exception, match=why):
            read.collect()


def test_recordings_of_many_files_are_checked_each(spark, tmp_path):
    # small files share a task: the next one starts below where the one before it ended
    for i in range(12):
        (tmp_path / f"{i}.csv").write_text("t;value;flag\n" + "\n".join(f"{t};{i};0" for t in range(3)))
    part = lambda: tables.recording(spark, f"file://{tmp_path}", "t long, value double, flag int", "t", ("flag",), ";").coalesce(1)
    assert sorted((r["value"], r["t"]) for r in part().collect()) == [(i, t) for i in range(12) for t in range(3)]
    (tmp_path / "12.csv").write_text("t;value;flag\n1;12;0\n1;12;0")
    with pytest.raises(Exception, match="does not grow"):
        part().collect()


def test_delimiters_are_sniffed(spark, tmp_path):
    for name, text, want in (("a", "x,y|z\n1,2|3\n", None), ("b", "a;b;c,d\n1;2;3,4\n", ";"), ("c", "a\tb\n1\t2\n", "\t")):
        (tmp_path / name).write_text(text)
        if want:
            assert tables.sniffed(spark, f"file://{tmp_path}/{name}") == want
    (tmp_path / "d").write_text("plain\nwords\n")
    with pytest.raises(ValueError, match="no delimiter"):
        tables.sniffed(spark, f"file://{tmp_path}/d")

"""Delimited files, stage snapshots and arriving files."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from tidemark.plans import tables as K
from tidemark.session import new_folder
from tidemark.sources import extracts as X
from tidemark.sources import stage as S
from tidemark.streaming import landing as G

CODES = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("valid_from", T.DateType()),
        T.StructField("valid_to", T.DateType()),
        T.StructField("form", T.StringType()),
        T.StructField("_load_id", T.LongType()),
    ]
)


def write(tmp_path, body, encoding="utf-8"):
    path = tmp_path / "extract.csv"
    path.write_bytes(body.encode(encoding))
    return str(path)


BODY = '''"code";"level";"text";"valid_from";"valid_to";"form"
"000";1;"Plain";01.01.1900;09.09.9999;"10"
"01";2;"With ; and ""quotes""";31.12.2004;09.09.9999;
"02";;"";29.02.2004;09.09.9999;""

'''


def test_values_keep_their_meaning(spark, tmp_path):
    got = X.read_extract(spark, write(tmp_path, BODY), CODES).collect()
    end = dt.date(9999, 9, 9)
    assert [tuple(r) for r in got] == [
        ("000", 1, "Plain", dt.date(1900, 1, 1), end, "10"),
        ("01", 2, 'With ; and "quotes"', dt.date(2004, 12, 31), end, None),
        ("02", None, "", dt.date(2004, 2, 29), end, ""),
    ]


@pytest.mark.parametrize("bad", ['"03";1;"x";01.01.2000;09.09.9999', '"03";one;"x";01.01.2000;09.09.9999;"1"', '"03";1;"x";2000-01-01;09.09.9999;"1"'])
def test_rows_that_do_not_fit_fail(spark, tmp_path, bad):
    with pytest.raises(Exception):
        X.read_extract(spark, write(tmp_path, BODY.rstrip("\n") + "\n" + bad + "\n"), CODES).collect()


@pytest.mark.parametrize("name, codec", [("UTF8", "utf-8"), ("utf_8", "utf-8"), ("WIN1250", "cp1250"), ("win-1252", "cp1252"), ("LATIN2", "iso8859-2"), ("SQL_ASCII", None)])
def test_names_of_code_pages(spark, tmp_path, name, codec):
    if codec is None:
        with pytest.raises(LookupError):
            X.code_page_name(name)
        return
    assert X.code_page_name(name) == codec
    body = BODY.replace("Plain", "Žluťoučký" if codec != "cp1252" else "Straße")
    got = X.read_extract(spark, write(tmp_path, body, codec), CODES, encoding=name).collect()
    assert got[0]["text"] == ("Žluťoučký" if codec != "cp1252" else "Straße")
    path = str(tmp_path / "out")
    X.write_extract(spark.createDataFrame(got), path, encoding=name)
    again = X.read_extract(spark, path, CODES, encoding=name)
    assert rows(again) == sorted(map(tuple, got), key=repr)


@pytest.mark.parametrize("encoding", ["windows-1250", "iso-8859-2", "cp852"])
def test_single_byte_code_pages(spark, tmp_path, encoding):
    body = 'code;level;text;valid_from;valid_to;form\n"1";1;"Příliš žluťoučký kůň §";01.01.2000;09.09.9999;"Ž"\n'
    row = X.read_extract(spark, write(tmp_path, body, encoding), CODES, encoding=encoding).first()
    assert (row["text"], row["form"]) == ("Příliš žluťoučký kůň §", "Ž")


def test_every_byte_survives_a_code_page(spark):
    text = "".join(bytes([b]).decode("cp1250") for b in range(0x80, 0x100) if b not in (0x81, 0x83, 0x88, 0x90, 0x98))
    df = spark.createDataFrame([(text,)], "t string")
    path = new_folder(spark, "page")
    X.write_extract(df, path, encoding="windows-1250")
    raw = b"".join(open(os.path.join(path, f), "rb").read() for f in os.listdir(path) if f.endswith(".csv"))
    assert text.encode("cp1250") in raw
    assert X.read_extract(spark, path, df.schema, encoding="windows-1250").first()["t"] == text


@pytest.mark.parametrize("control", [False, True])
def test_written_files_read_back(spark, control):
    values = [("a;b", ""), ('say "x"', None), ("", " lead"), (None, "trail "), ("back\\slash", "ěščř"), ("tab\tand , comma", "'")]
    df = spark.createDataFrame(values, "a string, b string")
    path = new_folder(spark, "back")
    if control:
        X.write_control_dsv(df, path)
        got = X.read_control_dsv(spark, path, df.schema)
    else:
        X.write_extract(df, path)
        got = X.read_extract(spark, path, df.schema)
    assert rows(got) == sorted(values, key=repr)


def stage(spark):
    name = K.work_table(spark, "stage")
    schema = T._parse_datatype_string("id int, v string, _load_id bigint")
    S.create_stage(spark, name, schema)
    return name


def put(spark, name, load_id, ids):
    S.land_snapshot(spark, name, spark.createDataFrame([(i, str(load_id)) for i in ids], "id int, v string"), load_id)


def test_landing_is_idempotent_and_keeps_empty_snapshots(spark):
    name = stage(spark)
    put(spark, name, 20200101000000, [1, 2])
    put(spark, name, 20200102000000, [3])
    put(spark, name, 20200101000000, [5])
    S.land_snapshot(spark, name, spark.createDataFrame([], "id int, v string"), 20200103000000)
    assert rows(S.scan_all_snapshots(spark, name), "id") == [(3,), (5,)]
    assert rows(S.list_snapshots(spark, name)) == [(20200101000000, 3), (20200102000000, 2), (20200103000000, 1)]


def test_carry_forward_and_retention(spark):
    name = stage(spark)
    assert S.load_or_carry(spark, name, 20200101000000, lambda: spark.read.parquet("/nowhere")) == "skipped"
    for day in range(2, 7):
        put(spark, name, 20200100000000 + day * 1000000, [day])
    missing = lambda: X.read_extract(spark, "/nowhere.csv", CODES)
    assert S.load_or_carry(spark, name, 20200107000000, missing) == "carried"
    assert rows(S.scan_snapshot(spark, name, 20200107000000), "id") == [(6,)]
    assert S.carry_forward(spark, name, 20200104120000) == 20200104000000
    dropped = S.prune_snapshots(spark, name, 3)
    assert sorted(dropped) == [20200102000000, 20200103000000, 20200104000000, 20200104120000]
    assert rows(S.scan_all_snapshots(spark, name), "id") == [(5,), (6,), (6,)]
    assert S.prune_snapshots(spark, name, 3) == []


def test_an_extract_broken_half_way_fails_and_a_missing_one_is_carried(spark, tmp_path):
    name = K.work_table(spark, "stage")
    S.create_stage(spark, name, CODES)
    good = write(tmp_path, BODY)
    S.land_snapshot(spark, name, X.read_extract(spark, good, CODES), 20200101000000)
    broken = tmp_path / "broken.csv"
    broken.write_text(BODY.rstrip("\n") + "\n\"03\";x\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        S.load_or_carry(spark, name, 20200102000000, lambda: X.read_extract(spark, str(broken), CODES))
    with pytest.raises(Exception, match="(?i)malformed"):
        S.land_snapshot(spark, name, X.read_extract(spark, str(broken), CODES), 20200101000000)
    assert S.scan_snapshot(spark, name, 20200101000000).count() == 3
    gone = str(tmp_path / "gone.csv")
    assert S.load_or_carry(spark, name, 20200102000000, lambda: X.read_extract(spark, gone, CODES)) == "carried"
    assert S.scan_snapshot(spark, name, 20200102000000).count() == 3
    # A snapshot may be rewritten from itself, and become empty
    S.land_snapshot(spark, name, S.scan_snapshot(spark, name, 20200102000000).limit(2), 20200102000000)
    assert S.scan_snapshot(spark, name, 20200102000000).count() == 2
    S.land_snapshot(spark, name, S.scan_snapshot(spark, name, 20200102000000).limit(0), 20200102000000)
    assert S.scan_snapshot(spark, name, 20200102000000).count() == 0
    assert S.list_snapshots(spark, name).count() == 2


def test_refresh_retries_carries_and_prunes(spark):
    name = stage(spark)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            return spark.read.parquet("/nowhere")
        return spark.createDataFrame([(1, "x")], "id int, v string")

    assert S.refresh_stage(spark, name, 20200101000000, flaky, retention=2, wait=0) == "loaded"
    assert len(calls) == 3
    missing = lambda: spark.read.parquet("/nowhere")
    for day in (2, 3):
        assert S.refresh_stage(spark, name, 20200100000000 + day * 1000000, missing, retention=2, wait=0) == "carried"
    assert rows(S.list_snapshots(spark, name)) == [(20200102000000, 2), (20200103000000, 1)]
    assert S.scan_all_snapshots(spark, name).count() == 2


def test_scan_reads_one_partition(spark):
    name = stage(spark)
    put(spark, name, 20200101000000, [1])
    put(spark, name, 20200102000000, [2])
    plan = S.scan_snapshot(spark, name, 20200102000000)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_load_id" in plan


def test_drop_matching_takes_only_temporary_tables(spark):
    name = K.work_table(spark, "party")
    database, base = name.split(".")
    one = spark.range(1)
    for suffix in ("", "_t01", "_T99", "_t1", "_t001", "_x_t01"):
        K.create_from_query(name + suffix, one)
    assert sorted(K.drop_matching(spark, database, base)) == [f"{base}_t01", f"{base}_t99"]


def test_stream_replay_without_progress_changes_nothing(spark):
    root = new_folder(spark, "arrivals")
    schema = T._parse_datatype_string("id int, v string")
    name = K.work_table(spark, "landed")
    df = lambda ids: spark.createDataFrame([(i, "x") for i in ids], schema)
    X.write_extract(df([1, 2]), G.load_folder(root, 20200101000000))
    X.write_extract(df([2, 3]), G.load_folder(root, 20200102000000))
    progress = new_folder(spark, "progress")
    G.stream_land(spark, root, progress, name, schema, files_per_batch=1).awaitTermination()
    want = [(1, 20200101000000), (2, 20200101000000), (2, 20200102000000), (3, 20200102000000)]
    assert rows(spark.table(name), "id", "_load_id") == want
    G.stream_land(spark, root, progress, name, schema).awaitTermination()
    G.stream_land(spark, root, new_folder(spark, "progress"), name, schema).awaitTermination()
    assert rows(spark.table(name), "id", "_load_id") == want


def test_stream_history_skips_applied_loads(spark):
    root = new_folder(spark, "arrivals")
    schema = T._parse_datatype_string("id int, v string")
    name = K.work_table(spark, "history")
    K.create_history(spark, name, T._parse_datatype_string("id int, v string, start_ts timestamp_ntz, end_ts timestamp_ntz"))
    put_ = lambda load, data: X.write_extract(spark.createDataFrame(data, schema), G.load_folder(root, load))
    put_(20200101000000, [(1, "a"), (2, "a")])
    put_(20200102000000, [(1, "b"), (2, "a")])
    G.stream_scd2(spark, root, new_folder(spark, "p"), name, schema, ["id"]).awaitTermination()
    want = rows(spark.table(name).select("id", "v", F.year("end_ts").alias("y")))
    assert want == [(1, "a", 2020), (1, "b", 9999), (2, "a", 9999)]
    history = lambda: rows(spark.table(name).select("id", "v", F.year("end_ts").alias("y")))
    G.stream_scd2(spark, root, new_folder(spark, "p"), name, schema, ["id"]).awaitTermination()
    assert history() == want  # both loads seen again
    spark.createDataFrame([(3, "late")], schema).coalesce(1).write.mode("append").option("sep", ";").option("header", True).csv(
        G.load_folder(root, 20200102000000))
    G.stream_scd2(spark, root, new_folder(spark, "p"), name, schema, ["id"]).awaitTermination()
    assert history() == [*want, (3, "late", 9999)]  # another piece of the last load
    put_(20191231000000, [(9, "late")])
    with pytest.raises(Exception, match="came after"):
        G.stream_scd2(spark, root, new_folder(spark, "p"), name, schema, ["id"]).awaitTermination()
    assert history() == [*want, (3, "late", 9999)]
    assert G.last_load(spark, name) == 20200102000000

import datetime as dt
import shutil
import time

import pytest

from clearsift.functions.access import class_key
from clearsift.operators import logs
from clearsift.operators.access_log import daily_quota
from clearsift.operators.syslog import parse_syslog
from clearsift.streaming import access as access_stream
from clearsift.streaming import logs as log_stream
from clearsift.streaming.ledger import Fenced
from clearsift.sources import readers

BASE = dt.datetime(2026, 9, 1)
EVENTS = "event_id long, ts timestamp, host string, event_type string, raw string"


@pytest.fixture(scope="module")
def hosts(spark):
    return spark.createDataFrame(
        [("open", "HR", 1, None), ("secret", "HR", 3, []), ("dev", "Dev", 1, ["Dev"])],
        "name string, department string, required_clearance int, allowed_departments array<string>",
    )


@pytest.fixture(scope="module")
def events(spark):
    """Twenty old visible events, sixty newer hidden ones, one undated, one stray."""
    rows = [(i, BASE + dt.timedelta(minutes=i), "open", "a" if i % 2 else "b", "r") for i in range(20)]
    rows += [(100 + i, BASE + dt.timedelta(days=1, minutes=i), "secret", "a", "r") for i in range(60)]
    rows += [(200, None, "open", "a", "r"), (300, BASE + dt.timedelta(days=2), "stray", "a", "r")]
    return spark.createDataFrame(rows, EVENTS)


def asked(spark, rows):
    return spark.createDataFrame(
        rows, "request_id long, department string, clearance int, event_type string, since_ts timestamp, limit int"
    ).withColumn("class_key", class_key("department", "clearance"))


def answer(found):
    out = {}
    for r in found.orderBy("request_id", "rank").collect():
        out.setdefault(r.request_id, []).append(r.event_id)
    return out


def test_hidden_newer_rows_do_not_starve(spark, hosts, events):
    since = BASE + dt.timedelta(minutes=17)
    requests = asked(
        spark,
        [
            (1, "HR", 1, None, None, 10),
            (2, "HR", 1, "a", None, 3),
            (3, "HR", 1, None, since, 50),
            (4, "HR", 1, None, None, 999),
            (5, "HR", 3, None, None, 0),
            (6, "HR", 3, "missing", None, 5),
        ],
    )
    got = answer(logs.query_logs(events, hosts, requests))
    assert got[1] == list(range(19, 9, -1))
    assert got[2] == [19, 17, 15]
    assert got[3] == [19, 18, 17]
    assert got[4] == list(range(19, -1, -1)) + [200]
    assert got[5] == [159]
    assert 6 not in got


def test_limit_tops_out_at_fifty(spark, hosts, events):
    got = answer(logs.query_logs(events, hosts, asked(spark, [(1, "HR", 3, None, None, 60)])))
    assert got[1] == list(range(159, 109, -1))


def test_counts_by_principal(spark, hosts, events):
    people = spark.createDataFrame([("low", "HR", 1), ("high", "HR", 3)], "name string, department string, clearance int")
    rows = logs.event_counts(events, hosts, people).collect()
    assert {(r.name, r.event_type): r.event_count for r in rows} == {
        ("low", "a"): 11, ("low", "b"): 10, ("high", "a"): 71, ("high", "b"): 10,
    }
    assert len({r.scope for r in rows}) == 1


def test_malformed_since_is_rejected(spark):
    asked = spark.createDataFrame(
        [(1, None), (2, ""), (3, "2026-09-01T00:00:00"), (4, "soon"), (5, "2026-13-01")], "request_id long, since string"
    )
    good, bad = logs.valid_since(asked)
    assert {r.request_id for r in good.collect()} == {1, 2, 3}
    assert {r.request_id for r in bad.collect()} == {4, 5}


LINES = [
    ("ok", "Sep  1 10:00:00 open app: one"),
    ("ok", "Sep  1 10:00:00 open app: one"),
    ("ok", "Sep  1 10:00:01 open app: two"),
    ("ok", "junk"),
    ("bad", "Sep  1 10:00:02 open app: three"),
    ("bad", "Sep  1 10:00:03 nowhere app: four"),
    ("again", "Sep  1 10:00:00 open app: one"),
]


def test_load_is_all_or_nothing_per_file(spark, hosts):
    parsed = parse_syslog(spark.createDataFrame(LINES, "file string, value string"), 2026)
    stored = parsed.where("raw like '%two'")
    accepted = logs.accepted_events(parsed, hosts, stored)
    assert [(r.file, r.raw[-3:]) for r in accepted.collect()] == [("again", "one")]
    report = {r.file: (r.parsed, r.skipped, r.inserted, r.refused) for r in logs.load_report(parsed, accepted, hosts).collect()}
    assert report == {"ok": (3, 1, 0, False), "bad": (2, 0, 0, True), "again": (1, 0, 1, False)}


def test_undated_rows_are_never_repeats(spark):
    rows = [(1, None, "h", "a", "r"), (2, None, "h", "a", "r"), (3, BASE, "h", "a", "r"), (4, BASE, "h", "a", "r")]
    kept = logs.new_events(spark.createDataFrame(rows, EVENTS), None, "event_id").collect()
    assert sorted(r.event_id for r in kept) == [1, 2, 3]


def test_stream_refuses_files_and_ignores_redelivery(spark, hosts, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for name in ("ok", "bad"):
        (source / f"{name}.log").write_text("\n".join(l for f, l in LINES if f == name) + "\n")

    def run():
        stream = readers.stream_syslog(spark, str(source), files_per_batch=1)
        log_stream.load_logs(stream, hosts, 2026, out, str(tmp_path / "state")).awaitTermination()
        return log_stream.events(spark, out).count()

    assert run() == 2
    (source / "late.log").write_text("Sep  1 10:00:00 open app: one\nSep  2 10:00:00 open app: new\n")
    assert run() == 3
    refused = log_stream.refused(spark, out)
    assert {r.value[-4:] for r in refused.collect()} == {"hree", "four"}
    assert {r.file[-8:]: r.inserted for r in log_stream.reports(spark, out).collect()} == {
        "n/ok.log": 2, "/bad.log": 0, "late.log": 1,
    }


def _write(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(f"Sep  {day} 10:00:00 open app: {text}\n" for day, text in lines))


def _load(spark, hosts, tmp_path, state="state"):
    stream = readers.stream_syslog(spark, str(tmp_path / "in"), files_per_batch=1)
    log_stream.load_logs(stream, hosts, 2026, str(tmp_path / "out"), str(tmp_path / state)).awaitTermination()
    return sorted(r.raw[-3:] for r in log_stream.events(spark, str(tmp_path / "out")).collect())


def test_cleared_checkpoint_keeps_and_adds(spark, hosts, tmp_path):
    _write(tmp_path / "in", "a.log", (1, "one"), (2, "two"))
    assert _load(spark, hosts, tmp_path) == ["one", "two"]
    shutil.rmtree(tmp_path / "state")
    (tmp_path / "in" / "a.log").rename(tmp_path / "a.log")
    _write(tmp_path / "in", "b.log", (1, "new"), (2, "two"))
    assert _load(spark, hosts, tmp_path) == ["new", "one", "two"]
    shutil.rmtree(tmp_path / "state")
    (tmp_path / "a.log").rename(tmp_path / "in" / "a.log")
    assert _load(spark, hosts, tmp_path) == ["new", "one", "two"]
    assert _load(spark, hosts, tmp_path, "other") == ["new", "one", "two"]


def test_failed_and_repeated_attempts_show_once(spark, hosts, tmp_path, monkeypatch):
    _write(tmp_path / "in", "a.log", (1, "one"))

    def fails(*args):
        raise RuntimeError("lost before the commit")

    with monkeypatch.context() as broken:
        broken.setattr(log_stream.Ledger, "commit", fails)
        with pytest.raises(Exception, match="lost before the commit"):
            _load(spark, hosts, tmp_path)
    assert log_stream.events(spark, str(tmp_path / "out")).count() == 0
    assert _load(spark, hosts, tmp_path) == ["one"]
    commits = tmp_path / "state" / "commits"  # Spark did not see the batch end
    for file in commits.iterdir():
        file.unlink()
    assert _load(spark, hosts, tmp_path) == ["one"]


def test_ledger_refuses_what_does_not_belong(spark, hosts, tmp_path):
    _write(tmp_path / "in", "a.log", (1, "one"))
    assert _load(spark, hosts, tmp_path) == ["one"]
    out = str(tmp_path / "out")
    ledger = log_stream.Ledger(spark, out)
    writer = log_stream.writer_of(spark, str(tmp_path / "state"))
    assert ledger.find(writer, 0)["batch"] == 0
    with pytest.raises(Fenced, match="other lines"):
        ledger.done(writer, 0, "1:2:3")
    with pytest.raises(Fenced, match="follows none"):
        ledger.done(writer, 2, "1:2:3")
    epoch = ledger.take_over()
    ledger.take_over()
    with pytest.raises(Fenced, match="taken over"):
        ledger.commit(epoch, writer, 1, "x", "y")
    assert log_stream.events(spark, out).count() == 1


def test_quota_batch_and_stream(spark, tmp_path):
    rows = [(i, "u", BASE + dt.timedelta(minutes=i)) for i in range(6)]
    rows += [(10, "u", BASE + dt.timedelta(days=1)), (11, "v", BASE)] + [(20 + i, "free", BASE) for i in range(5)]
    requests = spark.createDataFrame(rows, "request_id long, user string, ts timestamp")
    exempt = spark.createDataFrame([("free",)], "user string")
    expected = {i: (i < 4, max(0, 3 - i)) for i in range(6)}
    expected |= {10: (True, 3), 11: (True, 3)} | {20 + i: (True, None) for i in range(5)}
    batch = daily_quota(requests, exempt, 4).collect()
    assert {r.request_id: (r.allowed, r.remaining) for r in batch} == expected

    source = str(tmp_path / "in")
    first, second = requests.where("request_id < 2"), requests.where("request_id >= 2")
    for part in (first, second):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(requests.schema).parquet(source)
        (
            access_stream.daily_quota(stream, exempt, 4)
            .writeStream.option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True)
            .start(str(tmp_path / "out"), format="parquet")
            .awaitTermination()
        )
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.request_id: (r.allowed, r.remaining) for r in got} == expected


def test_late_requests_are_answered(spark, tmp_path):
    day = dt.timedelta(days=1)
    arrivals = [[(1, "u", BASE), (2, "u", BASE + day)], [(3, "u", BASE + 2 * day)], [(4, "u", BASE), (5, "u", BASE + day), (6, "u", None)]]
    source = str(tmp_path / "in")
    for rows in arrivals:
        part = spark.createDataFrame(rows, "request_id long, user string, ts timestamp")
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).parquet(source)
        (
            access_stream.daily_quota(stream, spark.createDataFrame([], "user string"), 2)
            .writeStream.option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True)
            .start(str(tmp_path / "out"), format="parquet")
            .awaitTermination()
        )
    got = {r.request_id: (r.allowed, r.remaining) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (True, 1), 2: (True, 1), 3: (True, 1), 4: (False, 0), 5: (True, 0), 6: (False, 0)}


def test_state_of_idle_users_goes(spark, tmp_path):
    """Users that stay away lose their state, those that ask keep it."""
    source = str(tmp_path / "in")

    def ask(number, user):
        part = spark.createDataFrame([(number, user, BASE)], "request_id long, user string, ts timestamp")
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).parquet(source)
        query = (
            access_stream.daily_quota(
                stream, spark.createDataFrame([], "user string"), 2, idle=dt.timedelta(seconds=8)
            )
            .writeStream.option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True)
            .start(str(tmp_path / "out"), format="parquet")
        )
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert ask(1, "u") == 1
    time.sleep(9)
    assert ask(2, "v") == 1  # "u" is gone
    assert ask(3, "v") == 1
    ask(4, "u")
    got = {r.request_id: r.remaining for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 1}

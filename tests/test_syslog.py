import datetime as dt

from clearsift.operators.syslog import parse_syslog

LINES = [
    ("Sep  1 03:14:22 web-01 sshd[4412]: Failed password for invalid user admin from 1.2.3.4", "auth_failure", "admin"),
    ("Sep  1 03:14:22 web-01 sshd[4412]: Failed password for root from 1.2.3.4", "auth_failure", "root"),
    ("Sep  1 03:14:22 web-01 app: authentication failure; user=bob", "auth_failure", "bob"),
    ("Sep  1 03:14:22 web-01 sshd[1]: Accepted publickey for kim from 10.0.0.1", "session_open", "kim"),
    ("Sep  1 03:14:22 web-01 sshd[1]: session opened for user kim", "session_open", "kim"),
    ("Sep  1 03:14:22 web-01 sshd[1]: session closed for user kim", "session_close", "kim"),
    ("Sep  1 03:14:22 web-01 sudo:  kim : TTY=pts/1 ; USER=root", "privilege_use", "kim"),
    ("Sep  1 03:14:22 web-01 app: Permission denied for user eve", "access_denied", "eve"),
    ("Sep  1 03:14:22 web-01 CRON[7]: (root) CMD (x)", "other", None),
]
BROKEN = [
    "",
    "junk",
    "Feb 30 10:00:00 web-01 app: x",
    "Sep 31 10:00:00 web-01 app: x",
    "Sep  1 25:00:00 web-01 app: x",
    "Foo  1 10:00:00 web-01 app: x",
]


def test_types_and_users(spark):
    rows = parse_syslog(spark.createDataFrame([(l[0],) for l in LINES], "value string"), 2026).collect()
    got = {r.raw: (r.event_type, r.principal_name) for r in rows}
    assert got == {line: (kind, who) for line, kind, who in LINES}
    assert all(r.ts == dt.datetime(2026, 9, 1, 3, 14, 22) for r in rows)
    assert {r.host for r in rows} == {"web-01"}
    assert {r.process for r in rows} == {"sshd", "app", "sudo", "CRON"}


def test_broken_lines_have_no_time(spark):
    rows = parse_syslog(spark.createDataFrame([(l,) for l in BROKEN], "value string"), 2026)
    assert [r.ts for r in rows.collect()] == [None] * len(BROKEN)


def test_leap_day_depends_on_the_year(spark):
    line = spark.createDataFrame([("Feb 29 10:00:00 h app: x",)], "value string")
    assert parse_syslog(line, 2024).head().ts is not None
    assert parse_syslog(line, 2025).head().ts is None

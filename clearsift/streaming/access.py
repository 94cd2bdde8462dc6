"""Access records and quotas over arriving requests."""

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clearsift.constants import DAILY_QUOTA
from clearsift.schema import RECORD_COLUMNS

QUOTA_SCHEMA = "request_id long, user string, day date, allowed boolean, remaining int"


def append_records(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append arriving access records to day partitions, each exactly once."""
    return (
        records.select(*RECORD_COLUMNS, F.to_date("ts").alias("dt"))
        .writeStream.partitionBy("dt")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path, format="parquet")
    )


def daily_quota(
    requests: DataFrame,
    exempt: DataFrame,
    limit: int = DAILY_QUOTA,
    days: int = 2,
    idle: dt.timedelta = dt.timedelta(days=2),
) -> DataFrame:
    """Quota verdicts over a stream of (request_id, user, ts): one for every
    request, however late it comes.

    Exempt users branch off before any state.  The state of another user is a
    counter for each of the newest ``days`` UTC days it has asked on; a request
    for an older day is refused, as its count is gone.  Requests of one trigger
    are served in time order; only the candidates for the remaining places of
    those days are held in memory.

    A user's state is removed once no request of the user has arrived for
    ``idle``, by the clock of the triggers, so state follows the users of the
    last days and not all there ever were; a request that comes later starts a
    new count.  That clock is an event time of its own, always up to date, so
    its watermark drops no request.
    """
    free = exempt.select("user").distinct()
    arrived = F.current_timestamp().alias("arrived")
    dated = requests.select("request_id", "user", "ts", F.to_date("ts").alias("day"), arrived)
    dated = dated.withWatermark("arrived", "0 seconds")
    unlimited = dated.join(free, "user").select(
        "request_id",
        "user",
        "day",
        F.lit(True).alias("allowed"),
        F.lit(None).cast("int").alias("remaining"),
    )

    zone = requests.sparkSession.conf.get("spark.sql.session.timeZone")
    stays = max(1, int(idle.total_seconds() * 1000))

    def serve(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {}
        used = {dt.date.fromisoformat(day): n for day, n in held.items()}
        first, newest_arrival = {}, None

        def verdicts(rows, allowed, remaining):
            return pd.DataFrame(
                {
                    "request_id": rows["request_id"],
                    "user": key[0],
                    "day": rows["day"],
                    "allowed": allowed,
                    "remaining": pd.array(remaining, dtype="Int32"),
                }
            )

        for frame in frames:
            last = frame["arrived"].max()
            newest_arrival = last if newest_arrival is None else max(last, newest_arrival)
            for day, rows in frame.groupby("day", dropna=False):
                counted = not pd.isna(day) and (
                    len(used) < days or day in used or day > min(used)
                )
                places = max(0, limit - used.get(day, 0)) if counted else 0
                pool = pd.concat([first[day], rows]) if day in first else rows
                pool = pool.sort_values(["ts", "request_id"], kind="stable")
                if counted:
                    first[day] = pool.iloc[:places]
                if len(pool) > places:
                    rest = pool.iloc[places:]
                    yield verdicts(rest, False, [0] * len(rest))
        for day in sorted(first):
            rows = first[day]
            before = used.get(day, 0)
            used[day] = before + len(rows)
            if len(rows):
                yield verdicts(rows, True, [limit - before - n - 1 for n in range(len(rows))])
        newest = sorted(used)[-days:]
        state.update((json.dumps({day.isoformat(): used[day] for day in newest}),))
        stamp = newest_arrival if newest_arrival.tzinfo else newest_arrival.tz_localize(zone)
        state.setTimeoutTimestamp(int(stamp.timestamp() * 1000) + stays)

    limited = (
        dated.join(free, "user", "left_anti")
        .groupBy("user")
        .applyInPandasWithState(
            serve,
            outputStructType=QUOTA_SCHEMA,
            stateStructType="used string",
            outputMode="append",
            timeoutConf=GroupStateTimeout.EventTimeTimeout,
        )
    )
    return limited.union(unlimited.select("request_id", "user", "day", "allowed", "remaining"))

"""Reservations with their events and charging sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.operators.ranking import rank_by_ranges
from kerbside.sources.tables import append_rows, cut_lineage

KEY = "reservation_id"
#: Children of a reservation that one task ranks; those of larger ones are ranked by ranges.
HOT = 100_000


def _children(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events and sessions as rows of one shape: key, kind, and one struct per kind."""
    event = F.struct(*[c for c in events.columns if c != KEY])
    session = F.struct(*[c for c in sessions.columns if c != KEY])
    event_rows = events.select(
        KEY, F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("child_id"), event.alias("event")
    )
    session_rows = sessions.select(
        KEY,
        F.lit("session").alias("kind"),
        F.col("session_id").cast("string").alias("child_id"),
        session.alias("session"),
    )
    return event_rows.unionByName(session_rows, allowMissingColumns=True)


def _with_childless(reservations: DataFrame, matched: DataFrame, *children: DataFrame) -> DataFrame:
    """``matched`` parents plus those without children.

    An inner join and anti joins on the keys alone in place of one left join: Spark can
    split a hot parent on either side of an inner join, but not on the child side of a
    left join.
    """
    childless = reservations
    for rows in children:
        childless = childless.join(rows.select(KEY).distinct(), KEY, "left_anti")
    return matched.unionByName(childless, allowMissingColumns=True)


def reservation_rows(reservations: DataFrame, events: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per child, the parent's columns repeated; a childless parent gives one row of no kind.

    Children stay rows, so a parent of any size is spread over tasks.
    """
    matched = _children(events, sessions).join(reservations, KEY)
    return _with_childless(reservations, matched, events, sessions)


def _turn(at: str, child_id: str, newest_first: bool) -> list[Column]:
    """The order of a list: by time and id; no time comes last."""
    turn = (lambda c: c.desc_nulls_last()) if newest_first else (lambda c: c.asc_nulls_last())
    return [turn(F.col(at)), turn(F.col(child_id))]


def _ranked_by_key(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Children of both kinds with ``rank`` from 0 in their list, moved once: dealt by reservation and ranked there."""
    order = [*_turn("event.recorded_at", "event.event_id", True), *_turn("session.started_at", "session.session_id", False)]
    in_list = Window.partitionBy(KEY, "kind").orderBy(*order)
    rows = _children(events, sessions).drop("child_id").repartition(KEY)
    return rows.withColumn("rank", (F.row_number().over(in_list) - 1).cast("bigint")).drop("kind")


def _ranked_by_ranges(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """The same for reservations whose children are too many for one task.

    Ranks come from sampled ranges of (reservation, time, id), so one reservation's
    children on one day, or all those without a time, are spread over tasks too.
    """
    def ranked(rows: DataFrame, kind: str, order: list[Column]) -> DataFrame:
        child = F.struct(*[c for c in rows.columns if c != KEY]).alias(kind)
        return rank_by_ranges(rows, KEY, order).select(KEY, "rank", child)

    return ranked(events, "event", _turn("recorded_at", "event_id", True)).unionByName(
        ranked(sessions, "session", _turn("started_at", "session_id", False)), allowMissingColumns=True
    )


def _lists(ranked: DataFrame, page: int) -> DataFrame:
    """One row per reservation and page, with both lists as (rank, row) in order."""
    def row(kind: str) -> Column:
        return F.when(F.col(kind).isNotNull(), F.struct("rank", F.col(kind).alias("row"))).alias(kind)

    paged = ranked.select(KEY, F.floor(F.col("rank") / page).alias("part"), row("event"), row("session"))
    return paged.groupBy(KEY, "part").agg(
        F.sort_array(F.collect_list("event")).alias("_events"), F.sort_array(F.collect_list("session")).alias("_sessions")
    )


def _large_keys(events: DataFrame, sessions: DataFrame, hot: int) -> DataFrame:
    """Reservations with more than ``hot`` children: at most one for each ``hot`` children, written once."""
    counts = events.select(KEY).unionByName(sessions.select(KEY)).groupBy(KEY).agg(F.count("*").alias("n"))
    return cut_lineage(counts.filter(F.col("n") > hot).select(KEY))


def reservation_detail(
    reservations: DataFrame, events: DataFrame, sessions: DataFrame, page: int = 10_000, hot: int = HOT
) -> DataFrame:
    """Each reservation with its event list, newest first, and its session list, oldest first, in pages.

    ``part`` k holds ranks k * page up to (k + 1) * page of both lists, so the lists of a
    reservation's parts, one after the other, are its whole lists in order. A
    reservation without children is one row, part 0, with empty lists.

    Children move once: they are dealt by reservation, and ranked, gathered in pages and
    joined to their reservation where they are. Those of reservations with more than
    ``hot`` children are ranked by sampled ranges and dealt by page, over as many tasks
    as they need.
    """
    events, sessions = (rows.filter(F.col(KEY).isNotNull()) for rows in (events, sessions))
    large = _large_keys(events, sessions, hot)
    if large.isEmpty():
        joined = reservations.join(_lists(_ranked_by_key(events, sessions), page), KEY, "left")
    else:
        rest = [rows.join(large, KEY, "left_anti") for rows in (reservations, events, sessions)]
        joined = rest[0].join(_lists(_ranked_by_key(*rest[1:]), page), KEY, "left")
        of_large = [rows.join(large, KEY, "left_semi") for rows in (reservations, events, sessions)]
        pages = _lists(_ranked_by_ranges(*of_large[1:]), page)
        # every large reservation has children; Spark can split a hot key of an inner join on either side
        joined = joined.unionByName(of_large[0].join(pages, KEY))
    none = [F.array().cast(joined.schema[c].dataType) for c in ("_events", "_sessions")]
    return joined.select(
        KEY,
        F.coalesce("part", F.lit(0).cast("bigint")).alias("part"),
        *[c for c in reservations.columns if c != KEY],
        F.coalesce("_events", none[0])["row"].alias("events"),
        F.coalesce("_sessions", none[1])["row"].alias("sessions"),
    )

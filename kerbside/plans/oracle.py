"""The same results in plain SQL over the given tables, one text per query name."""

from __future__ import annotations

DAILY = """
SELECT lot_id, day, CAST(SUM(r) AS BIGINT) AS reservations_count,
       CAST(SUM(c) AS BIGINT) AS charging_sessions_count,
       SUM(e) AS energy_kwh, CAST(SUM(v) AS BIGINT) AS revenue_cents
FROM (SELECT c_nationkey AS lot_id, CAST(o_orderdate AS DATE) AS day, 1 AS r, 0 AS c,
             CAST(0 AS DOUBLE) AS e, CAST(0 AS BIGINT) AS v
      FROM orders JOIN customer ON o_custkey = c_custkey
      UNION ALL
      SELECT s_nationkey, CAST(l_shipdate AS DATE), 0, 1, l_quantity,
             CAST(ROUND(l_extendedprice * 100) AS BIGINT)
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) u
GROUP BY lot_id, day
"""

LATEST = f"""
SELECT lot_id, day, reservations_count, charging_sessions_count, energy_kwh, revenue_cents
FROM (SELECT d.*, ROW_NUMBER() OVER (PARTITION BY lot_id ORDER BY day DESC) AS rn FROM ({DAILY}) d) x
WHERE rn = 1
"""

OPEN_SPOTS = """
SELECT c_nationkey AS lot_id, COUNT(*) FILTER (WHERE c_acctbal > 4500) AS available_spots
FROM customer GROUP BY c_nationkey
"""

SPOTS = """
SELECT c_custkey AS spot_id, c_nationkey AS lot_id, c_name AS label,
       c_acctbal > 4500 AS is_available, c_mktsegment = 'AUTOMOBILE' AS supports_ev
FROM customer
"""

SLOTS = """
SELECT c_custkey AS slot_id,
       CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'EV' ELSE 'Parking' END AS type,
       CASE WHEN c_acctbal > 4500 THEN 'Available' ELSE 'Occupied' END AS status
FROM customer
"""

RESERVATIONS = """
SELECT o_orderkey AS reservation_id, o_custkey AS spot_id, c_nationkey AS lot_id, o_orderdate AS start_time,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'reserved' ELSE 'active' END AS status
FROM orders JOIN customer ON o_custkey = c_custkey
"""

RESERVATION_EVENTS = """
SELECT o_orderkey AS reservation_id, 'reserved' AS status, o_orderdate AS recorded_at FROM orders
UNION ALL
SELECT o_orderkey, 'completed', o_orderdate + INTERVAL 1 DAY FROM orders WHERE o_orderstatus = 'F'
"""

SLOT_RESERVATIONS = """
SELECT o_orderkey AS reservation_id, o_custkey AS slot_id, strftime(o_orderdate, '%Y-%m-%d') AS date,
       o_orderkey AS created_at
FROM orders
"""


def _requests(kind: str) -> str:
    lot = "CAST(o_orderkey % 25 AS INTEGER)" if kind == "claimed" else "c_nationkey"
    plate, start = "TRUE", "o_orderdate"
    if kind == "untidy":
        plate = "o_orderpriority <> '5-LOW'"
        start = """CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN NULL
                   WHEN '3-MEDIUM' THEN TIMESTAMP '2001-08-01' ELSE o_orderdate END"""
    return f"""
SELECT o_orderkey AS seq, o_custkey AS spot_id, {lot} AS lot_id, {start} AS start_at,
       {plate} AS complete, c_acctbal > 4500 AS avail, c_nationkey = {lot} AS lot_ok
FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""


def _decisions(kind: str) -> str:
    return f"""
SELECT seq, spot_id, lot_id, start_at,
       CASE WHEN NOT complete OR NOT lot_ok THEN 400
            WHEN NOT avail OR winner < seq THEN 409
            WHEN start_at IS NULL THEN 500 ELSE 201 END AS status,
       CASE WHEN NOT complete THEN 'lotId, spotId, vehiclePlate are required'
            WHEN NOT lot_ok THEN 'Spot not found for lot'
            WHEN NOT avail OR winner < seq THEN 'Spot is not available'
            WHEN start_at IS NULL THEN 'Internal server error' END AS message
FROM (SELECT q.*, MIN(CASE WHEN complete AND lot_ok AND avail AND start_at IS NOT NULL THEN seq END)
                    OVER (PARTITION BY spot_id) AS winner
      FROM ({_requests(kind)}) q) v"""


def _fanout(kind: str) -> str:
    return f"""
WITH won AS (SELECT * FROM ({_decisions(kind)}) t WHERE status = 201)
SELECT 'reservations' AS table_name, lot_id, CAST(start_at AS DATE) AS day, COUNT(*) AS n
FROM won GROUP BY lot_id, CAST(start_at AS DATE)
UNION ALL
SELECT 'reservation_events', CAST(NULL AS INTEGER), DATE '2001-08-01', COUNT(*) FROM won HAVING COUNT(*) > 0
UNION ALL
SELECT 'usage_events', lot_id, CAST(start_at AS DATE), -COUNT(*) FROM won GROUP BY lot_id, CAST(start_at AS DATE)
UNION ALL
SELECT 'metric_deltas', lot_id, CAST(start_at AS DATE), COUNT(*) FROM won GROUP BY lot_id, CAST(start_at AS DATE)
UNION ALL
SELECT 'spots', c_nationkey, CAST(NULL AS DATE), COUNT(*) FROM customer
WHERE c_acctbal > 4500 AND c_custkey NOT IN (SELECT spot_id FROM won) GROUP BY c_nationkey"""


SESSION_DECISIONS = """
SELECT l_orderkey AS reservation_id, l_linenumber AS line_number, station_id, s_nationkey AS lot_id,
       CASE WHEN station_id IS NULL THEN 400 WHEN s_suppkey IS NULL THEN 404 ELSE 201 END AS status,
       CASE WHEN station_id IS NULL THEN 'stationId is required'
            WHEN s_suppkey IS NULL THEN 'Charging station not found' END AS message,
       l_quantity AS energy_kwh, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS cost
FROM (SELECT *, CASE WHEN l_linenumber = 2 THEN -l_suppkey - 1 WHEN l_linenumber > 2 THEN l_suppkey END AS station_id
      FROM lineitem) q
LEFT JOIN supplier ON s_suppkey = station_id
"""

STATE_TEXTS = """
SELECT event_id,
       CASE WHEN event_type = 'error' THEN left(props, length(props) - 1)
            WHEN event_type = 'signup' THEN ''
            WHEN event_type = 'view' AND value < 50 THEN 'null'
            WHEN event_type = 'view' THEN regexp_replace(props, '[0-9]+', '"text"')
            ELSE props END AS text
FROM events
"""

# Reserves and releases: a status is the effect of the last command before.
SLOT_REPLAY = f"""
WITH log AS (
  SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'release' ELSE 'reserve' END AS command,
         user_id AS slot_id, status
  FROM events LEFT JOIN ({SLOTS}) s ON s.slot_id = user_id
  WHERE event_type IN ('signup', 'purchase', 'error')),
seen AS (
  SELECT log.*, CASE WHEN status IS NULL THEN NULL ELSE COALESCE(
           LAG(CASE command WHEN 'reserve' THEN 'Occupied' ELSE 'Available' END)
             OVER (PARTITION BY slot_id ORDER BY seq), status) END AS status_before
  FROM log)
SELECT seq, command, slot_id,
       CASE command WHEN 'release' THEN status_before IS NOT NULL
            ELSE COALESCE(status_before = 'Available', FALSE) END AS ok,
       CASE WHEN command = 'reserve' AND status_before IS NULL THEN 'Slot not found'
            WHEN command = 'reserve' AND status_before = 'Occupied' THEN 'Slot already occupied' END AS message,
       status_before,
       CASE WHEN status_before IS NULL THEN NULL
            WHEN command = 'reserve' THEN 'Occupied' ELSE 'Available' END AS status_after
FROM seen
"""

# A fold, one command per slot and step, with the slot's listed reservations in the state.
FOLD = f"""
RECURSIVE cmd AS (
  SELECT seq, command, reservation_id, has_time,
         CASE WHEN command = 'reserve' AND value BETWEEN 5 AND 8 OR event_type = 'click' THEN -user_id - 1
              ELSE user_id END AS slot_id, date, time
  FROM (SELECT e.*, event_id AS seq,
               CASE WHEN event_type IN ('signup', 'purchase') THEN 'reserve'
                    WHEN event_type = 'view' THEN 'cancel'
                    WHEN event_type = 'click' AND value > 300 THEN 'reset' ELSE 'release' END AS command,
               CASE WHEN event_type IN ('signup', 'purchase') THEN event_id
                    WHEN event_type = 'view'
                    THEN event_id - 1 - CAST(json_extract_string(props, '$.k') AS BIGINT) END AS reservation_id,
               value >= 5 AS has_time, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M') AS time
        FROM events e) q),
named AS (
  SELECT c.seq, c.command, c.reservation_id, c.has_time, c.date, c.time,
         CASE c.command WHEN 'reset' THEN NULL WHEN 'cancel' THEN r.slot_id ELSE c.slot_id END AS slot_id,
         c.command = 'cancel' AND (r.seq IS NULL OR
           ROW_NUMBER() OVER (PARTITION BY c.command, c.reservation_id ORDER BY c.seq) > 1) AS idle
  FROM cmd c LEFT JOIN cmd r ON c.command = 'cancel' AND r.command = 'reserve'
       AND r.reservation_id = c.reservation_id AND r.seq < c.seq),
slot AS ({SLOTS}),
step AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY slot_id ORDER BY seq) AS pos
  FROM (SELECT n.slot_id, n.seq, n.command, n.reservation_id, n.has_time FROM named n JOIN slot USING (slot_id)
        UNION ALL
        SELECT slot.slot_id, n.seq, n.command, NULL, NULL FROM named n CROSS JOIN slot WHERE n.command = 'reset') u),
fold AS (
  SELECT slot_id, CAST(0 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS seq, FALSE AS ok, status AS status_before,
         status AS status_after, CAST([] AS BIGINT[]) AS listed
  FROM slot
  UNION ALL
  SELECT f.slot_id, s.pos, s.seq,
         CASE s.command WHEN 'reserve' THEN f.status_after = 'Available' AND s.has_time
              WHEN 'cancel' THEN list_contains(f.listed, s.reservation_id) ELSE TRUE END,
         f.status_after,
         CASE s.command
              WHEN 'reserve' THEN CASE WHEN s.has_time THEN 'Occupied' ELSE f.status_after END
              WHEN 'cancel' THEN CASE WHEN list_contains(f.listed, s.reservation_id) THEN 'Available'
                                      ELSE f.status_after END
              ELSE 'Available' END,
         CASE s.command
              WHEN 'reserve' THEN CASE WHEN f.status_after = 'Available' AND s.has_time
                                       THEN list_append(f.listed, s.reservation_id) ELSE f.listed END
              WHEN 'cancel' THEN list_filter(f.listed, lambda r: r <> s.reservation_id)
              WHEN 'reset' THEN CAST([] AS BIGINT[]) ELSE f.listed END
  FROM fold f JOIN step s ON s.slot_id = f.slot_id AND s.pos = f.pos + 1),
ended AS (SELECT slot_id, arg_max(status_after, pos) AS status, arg_max(listed, pos) AS listed
          FROM fold GROUP BY slot_id)
"""

def _occupied(last: str = "arg_max(value, event_id)") -> str:
    return f"""
SELECT lot_id, day, COALESCE(reservations_count, 0) AS reservations_count,
       COALESCE(charging_sessions_count, 0) AS charging_sessions_count,
       COALESCE(energy_kwh, CAST(0 AS DOUBLE)) AS energy_kwh, COALESCE(revenue_cents, 0) AS revenue_cents,
       avg_occupancy_percent
FROM ({DAILY}) d FULL JOIN (
  SELECT CAST(user_id % 25 AS INTEGER) AS lot_id, CAST(ts AS DATE) AS day, {last} AS avg_occupancy_percent
  FROM events GROUP BY 1, 2) o USING (lot_id, day)"""


LATEST_OCCUPIED = f"""
SELECT * FROM ({_occupied()}) x QUALIFY ROW_NUMBER() OVER (PARTITION BY lot_id ORDER BY day DESC) = 1"""


def _detail_pages(page: int) -> str:
    cents = "CAST(ROUND(l_extendedprice * 100) AS BIGINT)"
    parts = f"l_orderkey, l_partkey, l_suppkey, l_linenumber, {cents}"
    return f"""
WITH e AS (SELECT reservation_id, status, recorded_at,
                  (ROW_NUMBER() OVER (PARTITION BY reservation_id ORDER BY recorded_at DESC) - 1) // {page} AS part
           FROM ({RESERVATION_EVENTS}) v),
lines AS (SELECT l_orderkey, l_shipdate, {cents} AS cost, sha256(concat_ws('|', 'session', {parts},
                 ROW_NUMBER() OVER (PARTITION BY {parts} ORDER BY l_shipdate, l_quantity) - 1)) AS session_id FROM lineitem),
s AS (SELECT l_orderkey AS reservation_id, cost,
             (ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, session_id) - 1) // {page} AS part FROM lines),
ep AS (SELECT reservation_id, part, COUNT(*) AS n_events, string_agg(status, ',' ORDER BY recorded_at DESC) AS event_statuses
       FROM e GROUP BY ALL),
sp AS (SELECT reservation_id, part, COUNT(*) AS n_sessions, CAST(SUM(cost) AS BIGINT) AS cost FROM s GROUP BY ALL),
p AS (SELECT reservation_id, part FROM ep UNION SELECT reservation_id, part FROM sp)
SELECT r.reservation_id, COALESCE(p.part, 0) AS part, r.status, COALESCE(n_events, 0) AS n_events,
       COALESCE(event_statuses, '') AS event_statuses, COALESCE(n_sessions, 0) AS n_sessions, COALESCE(cost, 0) AS cost
FROM ({RESERVATIONS}) r LEFT JOIN p USING (reservation_id)
LEFT JOIN ep ON ep.reservation_id = p.reservation_id AND ep.part = p.part
LEFT JOIN sp ON sp.reservation_id = p.reservation_id AND sp.part = p.part"""


ORACLE: dict[str, str] = {
    "analytics_daily": f"""
SELECT d.lot_id, n.n_name AS lot_name, d.day, d.reservations_count AS reservations,
       d.charging_sessions_count AS charging_sessions, d.energy_kwh, d.revenue_cents,
       n_nationkey % 2 = 0 AS has_ev_charging
FROM ({DAILY}) d JOIN nation n ON n.n_nationkey = d.lot_id
WHERE d.day >= DATE '2001-07-25' ORDER BY d.day, d.lot_id""",
    "daily_metrics": DAILY,
    "daily_metrics_with_occupancy": f"""
SELECT lot_id, day, COALESCE(reservations_count, 0) AS reservations_count,
       COALESCE(charging_sessions_count, 0) AS charging_sessions_count,
       COALESCE(energy_kwh, CAST(0 AS DOUBLE)) AS energy_kwh, COALESCE(revenue_cents, 0) AS revenue_cents,
       avg_occupancy_percent
FROM ({DAILY}) d FULL JOIN (
  SELECT CAST(user_id % 25 AS INTEGER) AS lot_id, CAST(ts AS DATE) AS day,
         arg_max(value, event_id) AS avg_occupancy_percent
  FROM events GROUP BY 1, 2) o USING (lot_id, day)""",
    "daily_last_occupancy": """
SELECT CAST(user_id % 25 AS INTEGER) AS lot_id, CAST(ts AS DATE) AS day,
       arg_max(value, event_id) AS avg_occupancy_percent
FROM events WHERE value IS NOT NULL GROUP BY 1, 2""",
    "latest_metric": LATEST,
    "merge_metrics": DAILY,
    "lots_overview": f"""
SELECT n_nationkey AS lot_id, n_name AS name, CAST(NULL AS VARCHAR) AS address, CAST(NULL AS INTEGER) AS total_spots,
       COALESCE(available_spots, 0) AS available_spots, CAST(NULL AS INTEGER) AS price_per_hour,
       n_nationkey % 2 = 0 AS has_ev_charging, CAST(NULL AS INTEGER) AS distance_meters,
       CAST(NULL AS DOUBLE) AS latest_avg_occupancy_percent, reservations_count AS latest_reservations
FROM nation LEFT JOIN ({OPEN_SPOTS}) a ON a.lot_id = n_nationkey LEFT JOIN ({LATEST}) m ON m.lot_id = n_nationkey""",
    "analytics_daily_with_occupancy": f"""
SELECT d.lot_id, n.n_name AS lot_name, d.day, d.reservations_count AS reservations,
       d.charging_sessions_count AS charging_sessions, d.energy_kwh, d.revenue_cents, d.avg_occupancy_percent,
       n_nationkey % 2 = 0 AS has_ev_charging
FROM ({_occupied()}) d JOIN nation n ON n.n_nationkey = d.lot_id WHERE d.day >= DATE '2000-06-27'""",
    "latest_metric_with_occupancy": LATEST_OCCUPIED,
    "lots_overview_with_occupancy": f"""
SELECT n_nationkey AS lot_id, n_name AS name, CAST(NULL AS VARCHAR) AS address, CAST(NULL AS INTEGER) AS total_spots,
       COALESCE(available_spots, 0) AS available_spots, CAST(NULL AS INTEGER) AS price_per_hour,
       n_nationkey % 2 = 0 AS has_ev_charging, CAST(NULL AS INTEGER) AS distance_meters,
       avg_occupancy_percent AS latest_avg_occupancy_percent, reservations_count AS latest_reservations
FROM nation LEFT JOIN ({OPEN_SPOTS}) a ON a.lot_id = n_nationkey LEFT JOIN ({LATEST_OCCUPIED}) m ON m.lot_id = n_nationkey""",
    "merge_metrics_with_occupancy": _occupied(
        "COALESCE(arg_max(value, event_id) FILTER (WHERE value > 50), arg_max(value, event_id) FILTER (WHERE value <= 50))"
    ),
    "lot_spots": f"SELECT * FROM ({SPOTS}) s WHERE lot_id = 3",
    "stations_scan": """
SELECT s_suppkey AS station_id, s_nationkey AS lot_id, s_name AS name, s_acctbal > 0 AS is_available FROM supplier""",
    "available_by_lot": OPEN_SPOTS,
    "lot_history": """
SELECT event_id, CAST(user_id % 25 AS INTEGER) AS lot_id, event_type, ts AS recorded_at
FROM events WHERE user_id % 25 = 3 ORDER BY ts DESC, event_id DESC LIMIT 200""",
    "lot_history_all": """
SELECT * FROM (
  SELECT event_id, CAST(user_id % 25 AS INTEGER) AS lot_id, event_type, ts AS recorded_at,
         CAST(ROW_NUMBER() OVER (PARTITION BY user_id % 25 ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rn
  FROM events) x WHERE rn <= 200""",
    "lot_history_by_days": """
SELECT * FROM (
  SELECT event_id, CAST(user_id % 25 AS INTEGER) AS lot_id, event_type, ts AS recorded_at,
         CAST(ROW_NUMBER() OVER (PARTITION BY user_id % 25 ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rn
  FROM events) x WHERE rn <= 200""",
    "reservation_lookup": f"""
SELECT a.reservation_id, r.spot_id, r.status, r.reservation_id IS NOT NULL AS found
FROM (SELECT l_orderkey AS reservation_id FROM lineitem UNION ALL SELECT -s_suppkey - 1 FROM supplier) a
LEFT JOIN ({RESERVATIONS}) r ON r.reservation_id = a.reservation_id""",
    "reservation_detail": f"""
SELECT r.reservation_id, r.spot_id, r.lot_id, r.status, r.start_time, c.kind, c.event_status, c.recorded_at,
       c.station_id, c.started_at, c.energy_kwh, c.cost
FROM ({RESERVATIONS}) r LEFT JOIN (
  SELECT reservation_id, 'event' AS kind, status AS event_status, recorded_at, CAST(NULL AS BIGINT) AS station_id,
         CAST(NULL AS TIMESTAMP) AS started_at, CAST(NULL AS DOUBLE) AS energy_kwh, CAST(NULL AS BIGINT) AS cost
  FROM ({RESERVATION_EVENTS}) e
  UNION ALL
  SELECT l_orderkey, 'session', NULL, NULL, l_suppkey, l_shipdate, l_quantity,
         CAST(ROUND(l_extendedprice * 100) AS BIGINT)
  FROM lineitem) c ON c.reservation_id = r.reservation_id""",
    "reservation_detail_nested": _detail_pages(10_000),
    "reservation_detail_pages": _detail_pages(3),
    "start_times": """
SELECT o_orderkey AS seq, CASE o_orderkey % 10
         WHEN 0 THEN d WHEN 1 THEN d + INTERVAL 10 HOUR + INTERVAL 20 MINUTE + INTERVAL 30 SECOND WHEN 2 THEN d + INTERVAL 18 HOUR
         WHEN 3 THEN d + INTERVAL 4 HOUR + INTERVAL 50 MINUTE + INTERVAL 30 SECOND
         WHEN 4 THEN d + INTERVAL 10 HOUR + INTERVAL 20 MINUTE + INTERVAL 30123 MILLISECOND
         WHEN 5 THEN d + INTERVAL 3 HOUR WHEN 6 THEN d + INTERVAL 123 MILLISECOND END AS start_at
FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS d FROM orders) o""",
    "lookback_texts": """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN DATE '2001-07-29' WHEN 1 THEN DATE '2001-07-20' WHEN 2 THEN DATE '0001-01-01'
         WHEN 3 THEN DATE '2001-08-03' WHEN 6 THEN DATE '0001-01-01' ELSE DATE '2001-07-25' END AS since
FROM events""",
    "nested_lot_flatten": """
SELECT s_suppkey AS lot_id, 'spot' AS kind, 'S' || i AS name, i % 2 = 1 AS is_available
FROM (SELECT s_suppkey, UNNEST(generate_series(1, s_suppkey % 4 + 1)) AS i FROM supplier) u
UNION ALL
SELECT s_suppkey, 'station', s_name, TRUE FROM supplier""",
    "admission_claimed_lot": _decisions("claimed"),
    "admission_own_lot": _decisions("own"),
    "admission_untidy": _decisions("untidy"),
    "reservation_fanout": _fanout("claimed"),
    "reservation_fanout_own_lot": _fanout("own"),
    "reservation_usage_events": f"""
SELECT lot_id, spot_id, 'reservation_start' AS event_type, start_at AS recorded_at, -1 AS delta_available
FROM ({_decisions("untidy")}) t WHERE status = 201""",
    "spots_after_reservations": f"""
SELECT c_custkey AS spot_id, c_nationkey AS lot_id,
       c_acctbal > 4500 AND c_custkey NOT IN (SELECT spot_id FROM ({_decisions("own")}) t WHERE status = 201)
         AS is_available
FROM customer""",
    "session_decisions": f"""
SELECT reservation_id, line_number, station_id, lot_id, status, message FROM ({SESSION_DECISIONS}) t""",
    "session_rejects": f"""
SELECT status, message, COUNT(*) AS n FROM ({SESSION_DECISIONS}) t WHERE status <> 201 GROUP BY status, message""",
    "session_ingest": f"""
SELECT lot_id, DATE '2001-08-01' AS day, CAST(0 AS BIGINT) AS reservations_count,
       COUNT(*) AS charging_sessions_count, SUM(energy_kwh) AS energy_kwh, CAST(SUM(cost) AS BIGINT) AS revenue_cents
FROM ({SESSION_DECISIONS}) t WHERE status = 201 GROUP BY lot_id""",
    "session_usage_events": f"""
SELECT lot_id, 'charging_start' AS event_type, TIMESTAMP '2001-08-01' AS recorded_at,
       '{{"stationId":' || station_id || '}}' AS metadata, COUNT(*) AS n
FROM ({SESSION_DECISIONS}) t WHERE status = 201 GROUP BY lot_id, station_id""",
    "slot_filter": f"SELECT * FROM ({SLOTS}) s WHERE type = 'Parking' AND status = 'Occupied'",
    "slot_filter_by_status": f"SELECT * FROM ({SLOTS}) s WHERE status = 'Available'",
    "ev_slots": f"SELECT * FROM ({SLOTS}) s WHERE type = 'EV'",
    "bookable_slots": f"SELECT s.*, status <> 'Occupied' AS is_bookable FROM ({SLOTS}) s",
    "slot_stats": f"""
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'Available') AS available,
       COUNT(*) FILTER (WHERE status = 'Occupied') AS occupied, (SELECT COUNT(*) FROM orders) AS reservations
FROM ({SLOTS}) s""",
    "system_analytics": f"""
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'Available') AS available,
       COUNT(*) FILTER (WHERE status = 'Occupied') AS occupied, COUNT(*) FILTER (WHERE type = 'EV') AS ev,
       COUNT(*) FILTER (WHERE type = 'Parking') AS parking, (SELECT COUNT(*) FROM orders) AS reservations
FROM ({SLOTS}) s""",
    "slot_vocabulary": SLOTS,
    "slot_labels": f"""
SELECT slot_id, type || ' ' || slot_id || ' — ' || status AS label,
       CASE WHEN status = 'Occupied' THEN 'Charging ⚡' ELSE 'Idle' END AS charging
FROM ({SLOTS}) s""",
    "reservations_newest_first": f"""
SELECT reservation_id, slot_id, '✅ Reserved ' || slot_id || ' on ' || date || ' at 09:00' AS message, created_at
FROM ({SLOT_RESERVATIONS}) r ORDER BY created_at DESC""",
    "reservations_after_cancel": f"""
SELECT * FROM ({SLOT_RESERVATIONS}) r
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey = r.reservation_id)""",
    "session_estimate": """
SELECT reservation_id, line_number, seconds, CAST(FLOOR(seconds / 60) AS BIGINT) AS minutes,
       CAST(7.2 AS DOUBLE) * (seconds / CAST(3600 AS DOUBLE)) AS energy_kwh,
       CAST(7.2 AS DOUBLE) * (seconds / CAST(3600 AS DOUBLE)) * CAST(18 AS DOUBLE) AS cost_rupees,
       printf('%.2f', CAST(7.2 AS DOUBLE) * (seconds / CAST(3600 AS DOUBLE))) AS energy_text,
       printf('%.0f', CAST(7.2 AS DOUBLE) * (seconds / CAST(3600 AS DOUBLE)) * CAST(18 AS DOUBLE)) AS cost_text
FROM (SELECT l_orderkey AS reservation_id, l_linenumber AS line_number, l_quantity * 60 AS seconds FROM lineitem) q""",
    "slot_replay": SLOT_REPLAY,
    "slot_replay_any_log": f"""
WITH {FOLD}
SELECT n.seq, n.command, CASE WHEN NOT idle THEN n.slot_id END AS slot_id,
       CASE WHEN n.command = 'reset' THEN TRUE ELSE COALESCE(f.ok, FALSE) END AS ok,
       CASE WHEN n.command <> 'reserve' OR f.ok THEN NULL
            WHEN f.status_before IS NULL THEN 'Slot not found'
            WHEN f.status_before = 'Occupied' THEN 'Slot already occupied'
            ELSE 'Please fill date & time' END AS message,
       CASE WHEN NOT idle THEN f.status_before END AS status_before,
       CASE WHEN NOT idle THEN f.status_after END AS status_after
FROM named n LEFT JOIN fold f ON f.slot_id = n.slot_id AND f.seq = n.seq""",
    "slots_after_replay": f"""
WITH {FOLD}
SELECT slot_id, slot.type, ended.status FROM slot JOIN ended USING (slot_id)""",
    "reservations_after_replay": f"""
WITH {FOLD}
SELECT u.reservation_id, u.slot_id, c.date, c.time, c.seq AS created_at
FROM (SELECT slot_id, UNNEST(listed) AS reservation_id FROM ended) u
JOIN cmd c ON c.command = 'reserve' AND c.reservation_id = u.reservation_id""",
    "json_state_load": f"""
SELECT event_id, text = 'null' AS is_null,
       CASE WHEN text = '' THEN -1 WHEN text = 'null' THEN NULL WHEN NOT json_valid(text) THEN -1
            ELSE COALESCE(TRY_CAST(json_extract_string(text, '$.k') AS INTEGER), -1) END AS k
FROM ({STATE_TEXTS}) t""",
    "json_state_load_list": """
SELECT event_id, event_type = 'view' AND value < 50 AS is_null,
       CAST(CASE WHEN event_type = 'view' AND value < 50 THEN NULL
                 WHEN event_type NOT IN ('error', 'signup', 'view', 'click') AND event_id % 3 <> 0 THEN 2 ELSE 1 END AS BIGINT) AS n,
       CASE WHEN event_type = 'view' AND value < 50 THEN NULL
            WHEN event_type NOT IN ('error', 'signup', 'view', 'click') AND event_id % 3 <> 0
            THEN CAST(json_extract(props, '$.k') AS INTEGER) ELSE -1 END AS k
FROM events""",
    "json_state_save": f"""
SELECT slot_id, '{{"slot_id":' || slot_id || ',"type":"' || type || '","status":"' || status || '"}}' AS state
FROM ({SLOTS}) s""",
}

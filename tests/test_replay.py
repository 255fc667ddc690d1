"""Replay against a fold over the log, one command after the other."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kerbside.operators import replay as R
from kerbside.sources.tables import cut_lineage


def fold(commands, slots):
    status = {s["slot_id"]: s["status"] for s in slots}
    listed, out = {}, {}
    for c in commands:
        slot, message, ok = c.get("slot_id"), None, True
        before = status.get(slot)
        if c["command"] == "reserve":
            if before is None:
                message = "Slot not found"
            elif before == "Occupied":
                message = "Slot already occupied"
            elif not c.get("date") or not c.get("time"):
                message = "Please fill date & time"
            else:
                status[slot] = "Occupied"
                listed[c["reservation_id"]] = slot
            ok = message is None
        elif c["command"] == "release":
            ok = before is not None
            if ok:
                status[slot] = "Available"
        elif c["command"] == "cancel":
            ok = c["reservation_id"] in listed
            if ok:
                slot = listed.pop(c["reservation_id"])
                before = status[slot]
                status[slot] = "Available"
        else:
            status = dict.fromkeys(status, "Available")
            listed.clear()
        out[c["seq"]] = (ok, message, before, status.get(slot))
    return out, status, listed


def check(frames, commands, slots, **options):
    """``replay`` gives the fold's outcomes, final slots and listed reservations."""
    want, status, listed = fold(commands, slots)
    log, held = frames("slot_commands", *commands), frames("slots", *slots)
    outcomes = cut_lineage(R.replay(log, held, **options))
    rows = outcomes.collect()
    assert len(rows) == len(commands)
    for r in rows:
        ok, message, before, after = want[r.seq]
        assert (r.ok, r.message) == (ok, message), r
        if r.command in ("reserve", "release") or (r.command == "cancel" and ok):
            assert (r.status_before, r.status_after) == (before, after), r
    assert {r.slot_id: r.status for r in R.slots_after(outcomes, log, held).collect()} == status
    assert {r.reservation_id: r.slot_id for r in R.reservations_after(outcomes, log).collect()} == listed


def slot_list(rnd, n=5):
    return [
        {"slot_id": f"S{i}", "type": "EV", "status": rnd.choice(["Available", "Occupied"])} for i in range(n)
    ]


def any_log(rnd, n):
    """Cancels name reservations that were turned away, cancelled, cleared or not made yet; S5 and S6 do not exist."""
    out = []
    for seq in range(n):
        x = rnd.random()
        slot = "S0" if rnd.random() < 0.4 else f"S{rnd.randrange(7)}"
        if x < 0.45:
            out.append({"seq": seq, "command": "reserve", "slot_id": slot, "date": "d" if rnd.random() < 0.9 else "",
                        "time": "t", "reservation_id": f"r{seq}"})
        elif x < 0.55:
            out.append({"seq": seq, "command": "release", "slot_id": slot})
        elif x < 0.99:
            out.append({"seq": seq, "command": "cancel", "reservation_id": f"r{max(0, seq - rnd.randrange(-3, 25))}"})
        else:
            out.append({"seq": seq, "command": "reset"})
    return out


@pytest.mark.parametrize("trial", range(3))
def test_any_log(frames, trial):
    rnd = random.Random(trial)
    check(frames, any_log(rnd, 400), slot_list(rnd), width=7)


def test_width_makes_no_difference(frames):
    rnd = random.Random(11)
    log, slots = any_log(rnd, 150), slot_list(rnd)
    for width in (1, 1000):
        check(frames, log, slots, width=width)


commands = st.lists(
    st.tuples(
        st.sampled_from(["reserve", "reserve", "cancel", "cancel", "release", "reset"]),
        st.integers(0, 2),
        st.integers(-1, 6),
    ),
    min_size=1,
    max_size=25,
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(commands)
def test_short_logs(frames, steps):
    log = []
    for seq, (command, slot, back) in enumerate(steps):
        row = {"seq": seq, "command": command}
        if command in ("reserve", "release"):
            row["slot_id"] = f"S{slot}"
        if command == "reserve":
            row.update(date="d", time="t", reservation_id=f"r{seq}")
        if command == "cancel":
            row["reservation_id"] = f"r{seq - back}"
        log.append(row)
    slots = [{"slot_id": f"S{i}", "type": "EV", "status": ["Available", "Occupied"][i % 2]} for i in range(2)]
    check(frames, log, slots, width=4)


def test_long_chain_of_dependent_cancels(frames):
    """Every reserve waits on the cancel before it; the slot is taken at first, so none works."""
    log = []
    for i in range(60):
        log.append({"seq": 2 * i, "command": "reserve", "slot_id": "S0", "date": "d", "time": "t", "reservation_id": f"r{i}"})
        log.append({"seq": 2 * i + 1, "command": "cancel", "reservation_id": f"r{i}"})
    for status in ("Occupied", "Available"):
        check(frames, log, [{"slot_id": "S0", "type": "EV", "status": status}], width=16)


def test_live_cancels_only(frames):
    rnd = random.Random(5)
    slots, log, seq = slot_list(rnd), [], 0
    while seq < 200:
        _, _, listed = fold(log, slots)
        x = rnd.random()
        if x < 0.3 and listed:
            log.append({"seq": seq, "command": "cancel", "reservation_id": rnd.choice(sorted(listed))})
        elif x < 0.4:
            log.append({"seq": seq, "command": "release", "slot_id": f"S{rnd.randrange(7)}"})
        elif x < 0.42:
            log.append({"seq": seq, "command": "reset"})
        else:
            log.append({"seq": seq, "command": "reserve", "slot_id": f"S{rnd.randrange(7)}", "date": "d", "time": "t",
                        "reservation_id": f"r{seq}"})
        seq += 1
    check(frames, log, slots, width=9, only_live_cancels=True)
    check(frames, log, slots, width=9)


def test_stale_reservation_frees_the_next_holder(frames):
    log = [
        {"seq": 0, "command": "reserve", "slot_id": "S0", "date": "d", "time": "t", "reservation_id": "old"},
        {"seq": 1, "command": "release", "slot_id": "S0"},
        {"seq": 2, "command": "reserve", "slot_id": "S0", "date": "d", "time": "t", "reservation_id": "new"},
        {"seq": 3, "command": "cancel", "reservation_id": "old"},
        {"seq": 4, "command": "reserve", "slot_id": "S0", "date": "d", "time": "t", "reservation_id": "third"},
    ]
    slots = [{"slot_id": "S0", "type": "EV", "status": "Available"}]
    assert fold(log, slots)[0][4][0]
    check(frames, log, slots)


def test_charging_and_blocking_count_as_reservations(spark, frames):
    starts = spark.createDataFrame(
        [(0, "C1", "r0"), (1, "C1", "r1"), (2, "", "r2"), (3, "C9", "r3")], "seq bigint, slot_id string, reservation_id string"
    )
    stops = spark.createDataFrame([(5, "C1")], "seq bigint, slot_id string")
    blocks = spark.createDataFrame([(4, "A1", "r4")], "seq bigint, slot_id string, reservation_id string")
    log = R.charging_commands(starts, stops).unionByName(R.admin_blocks(blocks), allowMissingColumns=True)
    held = frames("slots", {"slot_id": "C1", "type": "EV", "status": "Available"},
                  {"slot_id": "A1", "type": "Parking", "status": "Available"})
    outcomes = cut_lineage(R.replay(log, held))
    told = {r.seq: r.message for r in R.charging_messages(outcomes).collect()}
    assert told == {0: None, 1: "Charger already in use", 2: "Select an EV charger first", 3: "Charger not found",
                    4: None, 5: None}
    marks = {r.reservation_id: (r.date, r.time) for r in R.reservations_after(outcomes, log).collect()}
    assert marks == {"r0": ("CHARGING", "START"), "r4": ("ADMIN", "BLOCKED")}
    assert {r.slot_id: r.status for r in R.slots_after(outcomes, log, held).collect()} == {"C1": "Available", "A1": "Occupied"}


def test_clock_like_seq(frames):
    rnd = random.Random(23)
    log, slots = any_log(rnd, 150), slot_list(rnd)
    at = 0
    for c in log:
        at += rnd.randrange(1, 1 << 44)
        c["seq"] = at
    assert log[-1]["seq"] > 1 << 48
    check(frames, log, slots)


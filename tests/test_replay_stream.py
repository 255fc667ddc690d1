"""The streaming replay against the fold over the whole log, for random splits into batches and a restart."""

from __future__ import annotations

import random

import pytest
from test_replay import any_log, fold, slot_list

from kerbside import schemas
from kerbside.streaming import replay_stream as RS


def compare(spark, out, commands, slots, held):
    want, status, listed = fold(commands, slots)
    rows = RS.outcomes(spark, out).collect()
    assert sorted(r.seq for r in rows) == sorted(c["seq"] for c in commands)
    for r in rows:
        ok, message, before, after = want[r.seq]
        assert (r.ok, r.message) == (ok, message), r
        if r.command in ("reserve", "release") or (r.command == "cancel" and ok):
            assert (r.status_before, r.status_after) == (before, after), r
    now = {r.slot_id: r.status for r in RS.slots_now(spark, out, held).collect()}
    assert now == status


@pytest.mark.parametrize("trial", range(6))
def test_any_split_into_batches(spark, frames, tmp_path, trial):
    rnd = random.Random(100 + trial)
    commands, slots = any_log(rnd, 120), slot_list(rnd)
    held = frames("slots", *slots)
    cuts = sorted(rnd.sample(range(1, len(commands)), rnd.randrange(0, 6)))
    parts = [commands[a:b] for a, b in zip([0, *cuts], [*cuts, len(commands)])]
    out = str(tmp_path / "out")
    for batch, part in enumerate(parts):
        RS.process_batch(frames("slot_commands", *part) if part else spark.createDataFrame([], schemas.REQUESTS["slot_commands"]), batch, out, held)
    # a batch run again after a break changes nothing
    RS.process_batch(frames("slot_commands", *parts[-1]), len(parts) - 1, out, held)
    compare(spark, out, commands, slots, held)


def test_stream_restarts_from_its_checkpoint(spark, frames, tmp_path):
    rnd = random.Random(7)
    commands, slots = any_log(rnd, 150), slot_list(rnd)
    held = frames("slots", *slots)
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    half = len(commands) // 2
    for i, part in enumerate((commands[:40], commands[40:half])):
        frames("slot_commands", *part).coalesce(1).write.parquet(f"{src}/part-{i}")
    RS.start_replay_stream(spark, f"{src}/*", out, ckpt, held, files_per_batch=1).awaitTermination()
    for i, part in enumerate((commands[half:120], commands[120:]), start=2):
        frames("slot_commands", *part).coalesce(1).write.parquet(f"{src}/part-{i}")
    RS.start_replay_stream(spark, f"{src}/*", out, ckpt, held, files_per_batch=1).awaitTermination()
    compare(spark, out, commands, slots, held)

"""Slot state from a command log, and the outcome of each command.

Commands take effect in ``seq`` order, a dense arrival number:

* ``reserve`` occupies an available slot and adds a reservation;
* ``release`` makes a slot available and leaves its reservations listed;
* ``cancel`` removes a listed reservation and makes its slot available, even if
  someone else holds the slot by then; else it does nothing;
* ``reset`` makes every slot available and clears the list.

No slot's log is gathered in one place. The log is cut into chunks of ``width``
consecutive commands; a small table carries each slot's state into each chunk, and
within a chunk plain windows do the rest. A task therefore sorts at most ``width``
commands at a time, however busy one slot is.

A log may cancel reservations that were turned away, so whether a cancel works
depends on whether its reserve did, which may depend on an earlier cancel. Each
reserve waits on at most the cancels since the last command with a certain effect,
and each reservation has one first cancel, so these dependencies form a forest.
Acceptance spreads up the forest by pointer doubling, in as many rounds as the
logarithm of its depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import constants as K
from kerbside.functions import scalars as S
from kerbside.operators.prefix import max_before
from kerbside.sources.tables import cut_lineage, drop_written

WIDTH = 1 << 16
START = -1  # seq of the state before the log
BEFORE = Window.unboundedPreceding, -1


def _effect(seq: Column, occupies: Column) -> Column:
    """An effect as one number, twice its seq and one more if it occupies; the greatest is the last."""
    return seq.cast("bigint") * 2 + F.when(occupies, 1).otherwise(0)


def _effect_seq(effect: Column) -> Column:
    return F.shiftright(effect, 1)


def _effect_status(effect: Column) -> Column:
    return F.when(effect.bitwiseAND(F.lit(1).cast("bigint")) == 1, K.OCCUPIED).when(effect.isNotNull(), K.AVAILABLE)


def charging_commands(starts: DataFrame, stops: DataFrame) -> DataFrame:
    """Charging starts reserve a charger under a fixed mark; stops release a charger.

    A stop names its own slot.
    """
    date, time = K.CHARGING_MARK
    begun = starts.select(
        "seq",
        F.lit("reserve").alias("command"),
        "slot_id",
        F.lit(date).alias("date"),
        F.lit(time).alias("time"),
        "reservation_id",
    )
    ended = stops.select("seq", F.lit("release").alias("command"), "slot_id")
    return begun.unionByName(ended, allowMissingColumns=True)


def admin_blocks(blocks: DataFrame) -> DataFrame:
    """Slots an operator marks occupied, which counts as a reservation under a fixed mark."""
    date, time = K.ADMIN_BLOCK
    return blocks.select(
        "seq",
        F.lit("reserve").alias("command"),
        "slot_id",
        F.lit(date).alias("date"),
        F.lit(time).alias("time"),
        "reservation_id",
    )


def charging_messages(outcomes: DataFrame) -> DataFrame:
    """Messages of charging starts in their own words."""
    words = (
        F.when(S.is_blank(F.col("slot_id")), K.CHARGER_NOT_CHOSEN)
        .when(F.col("message") == K.SLOT_NOT_FOUND, K.CHARGER_NOT_FOUND)
        .when(F.col("message") == K.SLOT_OCCUPIED, K.CHARGER_IN_USE)
        .otherwise(F.col("message"))
    )
    return outcomes.withColumn("message", F.when(F.col("command") == "reserve", words).otherwise(F.col("message")))


def _name_slots(commands: DataFrame) -> DataFrame:
    """Commands with ``slot_id`` and ``made_at`` (the reserve's seq) filled in on first cancels.

    Only a reservation's first cancel can work; repeats keep a null slot. Other
    commands pass by the join.
    """
    is_cancel = F.col("command").eqNullSafe("cancel")
    cancels = commands.filter(is_cancel)
    made = commands.filter(F.col("command") == "reserve").select(
        "reservation_id", F.col("slot_id").alias("held_slot"), F.col("seq").alias("made_at")
    )
    first = (
        cancels.select("seq", "reservation_id")
        .join(made, "reservation_id")
        .filter(F.col("seq") > F.col("made_at"))
        .groupBy("reservation_id")
        .agg(
            F.min("seq").alias("seq"),
            F.first("held_slot").alias("slot_id"),
            F.first("made_at").alias("made_at"),
        )
        .drop("reservation_id")
    )
    return commands.filter(~is_cancel).unionByName(
        cancels.drop("slot_id").join(first, "seq", "left"), allowMissingColumns=True
    )


def _carry_over(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The greatest, which is the last, ``value`` before each row by ``order`` within ``keys``."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(*BEFORE)
    return df.withColumn("carried", F.max(value).over(window))


def _reset_marks(log: DataFrame, width: int) -> DataFrame:
    """Per chunk, the last reset before it.

    Carried over the chunks by a prefix maximum over levels of the chunk number's bits, so no
    window holds more than 65,536 chunks, however sparse ``seq`` is.
    """
    chunks = log.groupBy("chunk").agg(F.max(F.when(F.col("command") == "reset", F.col("seq"))).alias("reset_seq"))
    return max_before(chunks, "chunk", "reset_seq").select("chunk", F.col("before").alias("reset_seq")).filter(
        F.col("reset_seq").isNotNull()
    )


def _slot_marks(log: DataFrame, slots: DataFrame) -> DataFrame:
    """Per chunk and existing slot used in it, the slot's last certain effect before the chunk."""
    touched = log.filter(F.col("slot_id").isNotNull()).groupBy("slot_id", "chunk").agg(F.max("effect").alias("effect"))
    start = _effect(F.lit(START), F.col("status") == K.OCCUPIED)
    known = slots.select("slot_id", start.alias("start"))
    return _carry_over(touched.join(known, "slot_id"), ["slot_id"], "chunk", "effect").select(
        "slot_id", "chunk", F.coalesce("carried", "start").alias("effect"), F.lit(True).alias("known")
    )


def _certain_state(commands: DataFrame, slots: DataFrame, width: int, cancels_work: bool) -> DataFrame:
    """Each command with the last certain effect before it: its seq ``since`` and status ``base``.

    Certain effects are those of sound reserves (occupied, whether or not they were
    the ones to occupy the slot), releases, resets and, if ``cancels_work``, first
    cancels. ``base`` is null for slots that do not exist.
    """
    command = F.col("command")
    sound = (command == "reserve") & ~S.is_blank(F.col("date")) & ~S.is_blank(F.col("time"))
    frees = (command == "release") | (F.lit(cancels_work) & F.col("made_at").isNotNull())
    log = commands.withColumns(
        {
            "sound": sound,
            "chunk": F.expr(f"seq div {width}"),
            "effect": F.when(sound | frees, _effect(F.col("seq"), sound)),
        }
    )
    resets = _reset_marks(log.select("seq", "command", "chunk"), width)
    marks = _slot_marks(log, slots).unionByName(resets, allowMissingColumns=True)
    both = log.withColumn("reset_seq", F.when(command == "reset", F.col("seq"))).unionByName(
        marks, allowMissingColumns=True
    )
    # Marks have no seq and sort first. The second window is grouped within the
    # chunks of the first, so both use one shuffle.
    by_chunk = Window.partitionBy("chunk").orderBy("seq").rowsBetween(*BEFORE)
    by_slot = Window.partitionBy("chunk", "slot_id").orderBy("seq").rowsBetween(*BEFORE)
    reset = F.coalesce(F.col("last_reset"), F.lit(START - 1))
    wiped = reset > _effect_seq(F.col("own"))
    return (
        both.withColumn("last_reset", F.max("reset_seq").over(by_chunk))
        .withColumn("own", F.max("effect").over(by_slot))
        .withColumn("known", F.max("known").over(by_slot))
        .filter(F.col("seq").isNotNull())
        .withColumns(
            {
                "since": F.when(F.col("known"), F.when(wiped, reset).otherwise(_effect_seq(F.col("own")))),
                "base": F.when(F.col("known"), F.when(wiped, K.AVAILABLE).otherwise(_effect_status(F.col("own")))),
                # A reset between reserve and cancel has removed the reservation.
                "in_time": F.coalesce(F.col("made_at") > reset, F.lit(False)),
            }
        )
        .drop("own", "known", "effect", "chunk", "reset_seq", "last_reset")
    )


def _accepted_through_cancels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Seqs of accepted reserves among those tied to one another by cancels.

    ``nodes`` (seq, ok) says which reserves are accepted for certain; ``edges``
    (seq, parent) leads from a cancelled reserve to the one reserve its cancel makes
    way for. A reserve is accepted if it or any reserve below it is.
    """
    state = nodes.join(edges, "seq", "left").select("seq", "ok", F.col("parent").alias("jump"))
    state = cut_lineage(state)
    while not state.filter(F.col("jump").isNotNull()).isEmpty():
        told = state.filter("ok AND jump IS NOT NULL").groupBy(F.col("jump").alias("seq")).agg(
            F.lit(True).alias("told")
        )
        ahead = state.select(F.col("seq").alias("jump"), F.col("jump").alias("next"))
        before, state = state, cut_lineage(
            state.join(told, "seq", "left")
            .join(ahead, "jump", "left")
            .select("seq", (F.col("ok") | F.coalesce("told", F.lit(False))).alias("ok"), F.col("next").alias("jump"))
        )
        drop_written(before)
    return state.filter("ok").select("seq")


def _working_cancels(state: DataFrame) -> DataFrame:
    """Cancels that work, as (slot_id, since, seq, made_at), for any log."""
    cancels = state.filter((F.col("command") == "cancel") & F.col("in_time")).select(
        "slot_id", "since", "seq", "made_at"
    )
    reserves = state.filter("sound AND base IS NOT NULL").select(
        "slot_id", "since", F.col("seq").alias("reserve_seq"), (F.col("base") == K.AVAILABLE).alias("ok")
    )
    # The reserve that ends a stretch without certain effects is the only one in it.
    edges = cancels.join(
        reserves.filter(~F.col("ok")).select("slot_id", "since", F.col("reserve_seq").alias("parent")),
        ["slot_id", "since"],
    ).select(F.col("made_at").alias("seq"), "parent")
    named = cancels.select(F.col("made_at").alias("seq")).union(edges.select(F.col("parent").alias("seq"))).distinct()
    nodes = reserves.select(F.col("reserve_seq").alias("seq"), "ok").join(named, "seq")
    good = _accepted_through_cancels(nodes, edges).select(F.col("seq").alias("made_at"))
    return cancels.join(good, "made_at")


def _with_working_cancels(state: DataFrame) -> DataFrame:
    """``state`` with ``works`` on cancels and the status ``before`` each command."""
    is_cancel = F.col("command").eqNullSafe("cancel")
    working = _working_cancels(state)
    freed = working.groupBy("slot_id", "since").agg(F.min("seq").alias("freed_at"))
    judged = state.filter(is_cancel).join(working.select("seq", F.lit(True).alias("works")), "seq", "left")
    return (
        state.filter(~is_cancel)
        .unionByName(judged, allowMissingColumns=True)
        .withColumn("works", F.coalesce("works", F.lit(False)))
        .join(freed, ["slot_id", "since"], "left")
        .withColumn("before", F.when(F.col("freed_at") < F.col("seq"), K.AVAILABLE).otherwise(F.col("base")))
    )


def replay(
    commands: DataFrame, slots: DataFrame, width: int = WIDTH, only_live_cancels: bool = False
) -> DataFrame:
    """Each command with its slot, the slot's status before and after, ``ok`` and ``message``.

    ``only_live_cancels`` says that every cancel names a reservation listed at that
    moment, as a user interface ensures; the dependencies between cancels then need
    no resolving. Left false, any log gives the exact result.

    ``reservation_id`` must be set on reserves and differ between them. Resets have
    no slot and null statuses. Commands on unknown slots change nothing.
    """
    is_cancel = F.col("command").eqNullSafe("cancel")
    if only_live_cancels:
        state = _certain_state(_name_slots(commands), slots, width, cancels_work=True)
        state = state.withColumns({"works": is_cancel & F.col("in_time"), "before": F.col("base")})
    else:
        # Both tables are read several times.
        named = cut_lineage(_name_slots(commands))
        state = _with_working_cancels(cut_lineage(_certain_state(named, slots, width, cancels_work=False)))

    command, occupied = F.col("command"), F.col("before") == K.OCCUPIED
    reserve = command == "reserve"
    message = (
        F.when(reserve & F.col("base").isNull(), K.SLOT_NOT_FOUND)
        .when(reserve & occupied, K.SLOT_OCCUPIED)
        .when(reserve & ~F.col("sound"), K.SLOT_FIELDS_BLANK)
    )
    ok = F.when(reserve, F.col("message").isNull()).when(is_cancel, F.col("works")).otherwise(
        (command == "reset") | F.col("base").isNotNull()
    )
    after = (
        F.when(reserve & F.col("ok"), K.OCCUPIED)
        .when((command == "release") & F.col("ok"), K.AVAILABLE)
        .when(is_cancel & F.col("ok"), K.AVAILABLE)
        .otherwise(F.col("before"))
    )
    return (
        state.withColumn("message", message)
        .withColumn("ok", ok)
        .withColumn("after", after)
        .select(
            "seq",
            "command",
            "slot_id",
            "date",
            "time",
            "reservation_id",
            "ok",
            "message",
            F.col("before").alias("status_before"),
            F.col("after").alias("status_after"),
        )
    )


def _last_reset(commands: DataFrame):
    last = commands.filter(F.col("command") == "reset").agg(F.max("seq"))
    return F.coalesce(last.scalar(), F.lit(START - 1))


def slots_after(outcomes: DataFrame, commands: DataFrame, slots: DataFrame) -> DataFrame:
    """The slots as the log leaves them."""
    last = (
        outcomes.filter(F.col("status_after").isNotNull())
        .groupBy("slot_id")
        .agg(F.max(_effect(F.col("seq"), F.col("status_after") == K.OCCUPIED)).alias("effect"))
    )
    status = (
        F.when(_effect_seq(F.col("effect")) > F.col("reset_seq"), _effect_status(F.col("effect")))
        .when(F.col("reset_seq") > START - 1, K.AVAILABLE)
        .otherwise(F.coalesce(_effect_status(F.col("effect")), "status"))
    )
    return (
        slots.join(last, "slot_id", "left")
        .withColumn("reset_seq", _last_reset(commands))
        .withColumn("status", status)
        .select(*slots.columns)
    )


def reservations_after(outcomes: DataFrame, commands: DataFrame) -> DataFrame:
    """Reservations still listed at the end of the log."""
    reserve = F.col("command") == "reserve"
    return (
        outcomes.filter(F.col("ok") & (reserve | (F.col("command") == "cancel")))
        .groupBy("reservation_id")
        .agg(
            F.max(F.when(reserve, F.struct("seq", "slot_id", "date", "time"))).alias("made"),
            F.count_if(~reserve).alias("cancels"),
        )
        .filter((F.col("cancels") == 0) & (F.col("made.seq") > _last_reset(commands)))
        .select("reservation_id", "made.slot_id", "made.date", "made.time", F.col("made.seq").alias("created_at"))
    )

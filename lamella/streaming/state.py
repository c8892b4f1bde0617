"""Stateful operators of a live folder: quiet gate, file states, layout, channel groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANNELS = 16  # most channels of a layout


def _timer(ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if ms else GroupStateTimeout.NoTimeout


def quiet_sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """A key's arrivals between silences of ``gap``, given out once the watermark has passed the silence."""
    marked = events.withWatermark(ts, late)
    return marked.groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("first"), F.col("s.end").alias("quiet_at"), "n")


def complete_groups(files: DataFrame, required: list[int], ts: str | None = None, horizon: str | None = None) -> DataFrame:
    """(position, time_id, status) once every required channel has arrived; extra or doubled channels refuse it.

    A streaming aggregate in the JVM, for update mode; a group is told again when more of it
    arrives. With ``ts`` and ``horizon`` a group is closed after a silence of that length, is told
    once in append mode, and its state goes with the watermark.
    """
    wanted = F.array(*[F.lit(int(c)) for c in sorted(required)])
    keys = [F.col("position"), F.col("time_id")]
    if horizon:
        files = files.withWatermark(ts, horizon)
        keys = [F.session_window(ts, horizon), *keys]
    groups = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.col("channel").cast("int"))).alias("seen"))
    doubled = F.col("n") > F.size("seen")
    status = F.when(~doubled & (F.col("seen") == wanted), "complete").when(doubled | (F.size(F.array_except("seen", wanted)) > 0), "refused")
    return groups.select("position", "time_id", status.alias("status")).filter("status IS NOT NULL")


def depth_state(planes: Column, expected: Column, from_folder: Column | None = None) -> Column:
    """State by plane count: fewer than expected are incomplete, an unknown count stays unverified.

    More planes than the name says are a failure; more than the folder's file says only show that the
    file does not describe this volume, which stays unverified.
    """
    more = F.when(F.coalesce(from_folder, F.lit(False)), "DEPTH_UNVERIFIED").otherwise("FAILED") if from_folder is not None else F.lit("FAILED")
    return F.when(expected.isNull(), "DEPTH_UNVERIFIED").when(planes < expected, "INCOMPLETE").when(planes > expected, more).otherwise("COMPLETE")


def shown(files: DataFrame, allow_unverified: bool = False) -> DataFrame:
    """Files to show (state, arrived): those that arrived live with an unverified depth are withheld unless allowed."""
    return files if allow_unverified else files.filter(~(F.col("arrived") & (F.col("state") == "DEPTH_UNVERIFIED")))


def checked(planes: int | None, expected: int | None, from_folder: bool = False, problem: str | None = None, unsupported: str | None = None, changed: bool = False) -> tuple[str, str]:
    """State of a quiet file by its check, and why.

    ``problem`` is what its name is refused for, ``unsupported`` what its layout is; ``planes`` is unknown
    where the structure is not complete. A file that changed meanwhile has not been checked.
    """
    if changed:
        return "INCOMPLETE", "changed while it was checked"
    if problem:
        return "FAILED", problem
    if planes is None:
        return "INCOMPLETE", "structure is incomplete"
    if unsupported:
        return "FAILED", f"unsupported layout: {unsupported}"
    if expected is None:
        return "DEPTH_UNVERIFIED", "no plane count is known"
    if planes < expected:
        return "INCOMPLETE", f"{planes} of {expected} planes"
    if planes > expected:
        return ("DEPTH_UNVERIFIED", f"{planes} planes, the folder says {expected}") if from_folder else ("FAILED", f"{planes} planes, {expected} named")
    return "COMPLETE", "quiet and complete"


def next_state(known: tuple | None, size: int, mtime: int, planes: int | None, expected: int | None, **more) -> tuple[str, str]:
    """State of a file after an observation, and why.

    ``known`` is (size, mtime, state). A file is pending until two looks agree, then it is
    ``checked``. A later difference is a new version.
    """
    if size < 0:
        return "REMOVED", "the file is gone"
    if known is None or known[2] == "REMOVED":
        return "PENDING", "seen"
    if (known[0], known[1]) != (size, mtime):
        return ("CHANGED", "size or time changed") if known[2] in ("COMPLETE", "DEPTH_UNVERIFIED", "FAILED") else ("PENDING", "still growing")
    return checked(planes, expected, **more)


# What a look may say besides, and what holds where it does not.
CHECK = {"from_folder": "boolean", "problem": "string", "unsupported": "string", "size_after": "long", "mtime_after": "long"}


def file_states(looks: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """State transitions of every path from looks (path, seq, size, mtime, planes, expected).

    A look may also say whether ``expected`` comes ``from_folder``, a ``problem`` of the name, an ``unsupported``
    layout, and ``size_after, mtime_after`` of the file after it was checked. Rows: path, seq, state,
    reason; update mode, because a finished file may change. With a timeout, a file that is not
    looked at again in time is given up as failed; timers keep a stream running, so a stream that
    is to end takes none.
    """
    for name, kind in CHECK.items():
        if name not in looks.columns:
            looks = looks.withColumn(name, F.lit(None).cast(kind))

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState):
        out = []
        known = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            if known and known[2] in ("PENDING", "INCOMPLETE", "CHANGED"):
                out.append((key[0], -1, "FAILED", "no sign of life"))
            state.remove()
        else:
            for r in pd.concat(list(batches)).sort_values("seq").itertuples():
                given = lambda x: None if pd.isna(x) else x
                whole = lambda x: None if pd.isna(x) else int(x)
                after = (r.size if pd.isna(r.size_after) else int(r.size_after), r.mtime if pd.isna(r.mtime_after) else int(r.mtime_after))
                changed = after != (r.size, r.mtime)
                now, why = next_state(
                    known, int(r.size), int(r.mtime), whole(r.planes), whole(r.expected), from_folder=bool(given(r.from_folder)), problem=given(r.problem), unsupported=given(r.unsupported), changed=changed
                )
                if known is None or now != known[2]:
                    out.append((key[0], int(r.seq), now, why))
                known = (*(map(int, after) if changed and now == "INCOMPLETE" else (int(r.size), int(r.mtime))), now)
            state.update(known)  # also of a removed file, so that a further look at nothing tells nothing
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["path", "seq", "state", "reason"])

    return looks.groupBy("path").applyInPandasWithState(
        update, "path string, seq long, state string, reason string", "size long, mtime long, state string", "update", _timer(timeout_ms)
    )


BUCKETS = 1024  # states of a gate; the paths of a bucket share one, as calls and states cost more than looks


def _looked(turn: tuple | None, look: tuple, quiet: int, timeout: int) -> tuple[tuple | None, list]:
    """The turn (size, mtime, since, first, done) of a path after a look, and what is told: (at, outcome, size); times are milliseconds."""
    at, size, mtime, structure, *after = look
    seen, out = (size, mtime), []
    if turn and not turn[4] and at > turn[3] + timeout:
        out.append((turn[3] + timeout, "TIMEOUT", turn[0]))
        turn = (*turn[:4], True)
    if size < 0:
        if turn:
            out.append((at, "GONE", turn[0]))
        return None, out
    if turn is None or (turn[4] and turn[:2] != seen):
        return (*seen, at, at, False), out  # a new version, with a turn of its own
    if turn[4]:
        return turn, out
    if turn[:2] != seen:
        return (*seen, at, turn[3], False), out
    if at - turn[2] >= quiet and structure:
        if tuple(map(int, after)) != seen:
            return (*map(int, after), at, turn[3], False), out  # changed while it was checked
        out.append((at, "READY", size))
        return (*turn[:4], True), out
    return turn, out


def readiness(looks: DataFrame, ts: str, quiet_ms: int, timeout_ms: int, late: str) -> DataFrame:
    """``path, at, outcome, size``: when a file became READY, ran into its TIMEOUT or is GONE.

    Looks: path, ``ts``, size (-1: no file), mtime, structure (its directories were read and are complete),
    size_after, mtime_after (taken after that). A file is ready once it has been unchanged for ``quiet_ms``, its
    structure is complete and it is still the same after the check. A turn ends ``timeout_ms`` after the
    first look at a version, by an event-time timer where no look comes; a file that changes later has a
    turn of its own. ``at`` is in milliseconds; looks of a path are expected in order, within ``late``.
    Paths are dealt to ``BUCKETS`` states; the timer of a bucket is that of its turn that ends first.
    """
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    seen = ["size", "mtime", "structure", "size_after", "mtime_after"]
    rows = looks.withWatermark(ts, late).select(F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).alias("bucket"), "path", ts, at.alias("at"), *seen)

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState):
        turns = {path: tuple(turn) for path, *turn in zip(*state.get)} if state.exists else {}
        out, told_until = [], state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            given = pd.concat(list(batches)).sort_values("at", kind="stable")
            for path, *look in zip(*(given[k].tolist() for k in ["path", "at", *seen])):
                turn, told = _looked(turns.get(path), look, quiet_ms, timeout_ms)
                out += [(path, *x) for x in told]
                if turn is None:
                    turns.pop(path, None)
                else:
                    turns[path] = turn
        for path, turn in turns.items():
            if not turn[4] and turn[3] + timeout_ms < told_until:
                out.append((path, turn[3] + timeout_ms, "TIMEOUT", turn[0]))
                turns[path] = (*turn[:4], True)
        state.update(tuple(map(list, zip(*((path, *turn) for path, turn in turns.items())))) if turns else ([],) * 6)
        ends = [turn[3] + timeout_ms for turn in turns.values() if not turn[4]]
        if ends:
            state.setTimeoutTimestamp(max(min(ends), told_until + 1))
        yield pd.DataFrame(out, columns=["path", "at", "outcome", "size"])

    held = "path array<string>, size array<long>, mtime array<long>, since array<long>, first array<long>, done array<boolean>"
    return rows.groupBy("bucket").applyInPandasWithState(update, "path string, at long, outcome string, size long", held, "append", GroupStateTimeout.EventTimeTimeout)


def layout_of(names: list[tuple[int | None, int | None]], quiet: bool) -> tuple[str, list[int]] | None:
    """Layout decided by (time, channel) tokens in order of arrival, or None while more is needed.

    A layout of several channels holds all numbers up to the largest one met.
    """
    if not names:
        return None
    t0, c0 = names[0]
    if c0 is None:
        return "single", [1]
    first = [c for t, c in names if t == t0 and c is not None]
    filled = list(range(1, min(max(first), CHANNELS) + 1))
    later = next(((t, c) for t, c in names if t != t0), None)
    if later is not None:
        if len(set(first)) > 1:
            return "multi", filled
        return ("single", [max(1, c0)]) if later[1] == c0 else ("ambiguous", [max(1, c0)])
    if quiet:
        return ("multi", filled) if len(set(first)) > 1 else ("single", filled)
    return None


def layouts(files: DataFrame, quiet_ms: int | None = None) -> DataFrame:
    """One frozen layout decision per dataset from arriving (dataset, seq, time_id, channel).

    With ``quiet_ms``, silence of that length decides on what has arrived.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState):
        seen, decided = ([tuple(x) for x in state.get[0]], state.get[1]) if state.exists else ([], False)
        out = []
        if not decided:
            if not state.hasTimedOut:
                for r in pd.concat(list(batches)).sort_values("seq").itertuples():
                    seen.append(tuple(None if pd.isna(x) else int(x) for x in (r.time_id, r.channel)))
            choice = None
            for n in range(1, len(seen) + 1):
                choice = choice or layout_of(seen[:n], False)
            choice = choice or (layout_of(seen, True) if state.hasTimedOut else None)
            if choice:
                out.append((key[0], choice[0], ",".join(map(str, choice[1]))))
                seen, decided = [], True
        state.update((seen, decided))
        if not decided and quiet_ms:
            state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame(out, columns=["dataset", "kind", "channels"])

    return files.groupBy("dataset").applyInPandasWithState(
        update, "dataset long, kind string, channels string", "seen array<array<int>>, decided boolean", "update", _timer(quiet_ms)
    )


def capacity(samples: DataFrame) -> DataFrame:
    """Rate of use and hours left of every volume from (volume, ts, free): OK, WARNING or CRITICAL.

    A rate needs 30 s of samples; a volume that does not shrink has no end.
    """
    at = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    ends = samples.groupBy("volume").agg(
        F.min_by("free", "ts").alias("f0"), F.max_by("free", "ts").alias("free"), F.min(at).alias("t0"), F.max(at).alias("t1")
    )
    rate = F.when(F.col("t1") - F.col("t0") >= 30, (F.col("f0") - F.col("free")) / (F.col("t1") - F.col("t0")))
    hours = F.when(rate > 0, F.col("free") / rate / 3600)
    level = F.when((F.col("free") < 5e9) | (hours < 1), "CRITICAL").when(hours < 4, "WARNING").otherwise("OK")
    return ends.select("volume", "free", rate.alias("rate"), hours.alias("hours"), level.alias("level"))

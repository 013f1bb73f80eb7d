"""Threshold marks of a session's context size, each told once and armed again after a compaction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Sizes worth a word, room the host keeps, and the marks before a compaction: tokens ahead, least part of a small window.
SIZES = (500_000, 900_000)
RESERVE = 33_000
MARGINS = (("compact-critical", 50_000, 10), ("compact-warn", 80_000, 4))


def usage(rows: DataFrame) -> DataFrame:
    """(session_id, used, model) of the newest assistant message with a usage, of rows (session_id, pos, line); side chains do not count."""
    v = F.try_parse_json("line")
    get = lambda p, t: F.try_variant_get(v, p, t)
    field = lambda f: F.coalesce(get(f"$.message.usage.{f}", "long"), F.lit(0))
    used = field("input_tokens") + field("output_tokens") + field("cache_creation_input_tokens") + field("cache_read_input_tokens")
    side = F.coalesce(get("$.isSidechain", "boolean"), F.lit(False))
    kept = rows.select("session_id", "pos", used.alias("used"), get("$.message.model", "string").alias("model"), (get("$.message.role", "string") == "assistant").alias("own"), side.alias("side"))
    kept = kept.filter("own and not side and used > 0")
    return kept.groupBy("session_id").agg(F.max_by("used", "pos").alias("used"), F.max_by("model", "pos").alias("model"))


def marks(window: int, compacting: bool = True, sizes: tuple[int, ...] = SIZES) -> list[tuple[int, str]]:
    """(tokens, name) of every mark, lowest first.

    The marks before a compaction stand one outside the other, each by its margin or,
    in a small window, its part of it.
    """
    levels = {f"rot-{n}": n for n in sizes}
    end, margin = max(window - RESERVE, 1), 0
    for name, ahead, part in MARGINS if compacting else ():
        margin = min(ahead, max(end // part, margin + 1))
        levels[name] = end - margin
    return sorted((level, name) for name, level in levels.items() if level > 0)


def crossed(used: np.ndarray, most: int, levels: list[tuple[int, str]]) -> tuple[list[str | None], int]:
    """For each size in order the highest mark it is the first to cross, and the most seen since all were armed.

    A size under the lowest mark arms them all again.  ``most``: the largest size
    before, -1 if there was none.
    """
    if not levels or not len(used):
        return [None] * len(used), most
    steps = np.array([level for level, _ in levels])
    stretch = np.cumsum(used < steps[0])
    # sizes of later stretches are lifted over those before, so one running maximum serves all of them
    lift = int(max(used.max(), most, 0)) + 1
    raised = np.maximum.accumulate(np.append(most, used + stretch * lift))
    before = np.where(np.append(0, stretch[:-1]) == stretch, raised[:-1] - stretch * lift, -1)
    now, then = (np.searchsorted(steps, x, side="right") for x in (used, before))
    return [levels[n - 1][1] if n > t else None for n, t in zip(now, then)], int(raised[-1] - stretch[-1] * lift)


def alarms(rows: DataFrame, window: int) -> DataFrame:
    """A stream (session_id, at, used) as (session_id, used, mark); the state of a session is the most it has used since it was small."""
    levels = marks(window)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(batches)).sort_values("at")
        names, most = crossed(part["used"].to_numpy(np.int64), state.get[0] if state.exists else -1, levels)
        state.update((most,))
        told = pd.DataFrame({"session_id": key[0], "used": part["used"].to_numpy(), "mark": names})
        yield told[told["mark"].notna()]

    return rows.groupBy("session_id").applyInPandasWithState(step, "session_id string, used long, mark string", "most long", "append", GroupStateTimeout.NoTimeout)


def batch_alarms(rows: DataFrame, window: int, used: Column | None = None) -> DataFrame:
    """The same marks over stored rows (session_id, at, used): those a row is the first to cross since the context last was small.

    A row tells the highest of its new marks; a window counts how often the session
    was small before, so the marks of each stretch are told once.
    """
    from pyspark.sql.window import Window

    levels = marks(window)
    size = F.col("used") if used is None else used
    order = Window.partitionBy("session_id").orderBy("at")
    stretch = F.sum((size < levels[0][0]).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = Window.partitionBy("session_id", "stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.withColumn("stretch", stretch).withColumn("most", F.coalesce(F.max(size).over(before), F.lit(-1)))
    name = F.lit(None).cast("string")
    for level, label in levels:
        name = F.when((size >= level) & (F.col("most") < level), label).otherwise(name)
    return cut.select("session_id", F.col("used"), name.alias("mark")).filter("mark is not null")

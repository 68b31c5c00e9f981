"""Filling fixed-capacity containers with items by linear grouping."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.operators.running import global_rank
from tilewright.scratch import materialize


def _best_filling(value: np.ndarray, width: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest value that fits (widths may be repeated)."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for k in np.argsort(-width):
        w, v = int(width[k]), value[k]
        if v <= 0:
            continue
        for _ in range(capacity // w):
            with_k = best[:-w] + v
            better = with_k > best[w:] + 1e-12
            if not better.any():
                break
            best[w:][better] = with_k[better]
            took[w:][better] = k
    counts = np.zeros(len(width), np.int64)
    at, left = capacity, best[capacity]
    while at > 0 and left > 1e-9:  # walk back over what was taken last, as far as it fits the value
        k = took[at]
        if k < 0:
            at -= 1
            continue
        counts[k] += 1
        at -= int(width[k])
        left -= value[k]
    counts_width = int((counts * width).sum())
    if counts_width > capacity:
        raise AssertionError("a configuration exceeds the capacity")
    return float((counts * value).sum()), counts


def configurations(width: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 20_000) -> list[tuple[int, np.ndarray]]:
    """[(times, counts per width)] that together hold exactly need items of each width.

    The linear relaxation over all configurations is solved by column generation (a basis
    of as many configurations as widths; the next one is the best filling at the current
    prices). Its whole part is taken; the few items left go first-fit into more. Rounding
    errors could make it turn in circles, so it ends after the given number of rounds with a
    warning; the plan is valid then, but may take more containers.
    """
    k = len(width)
    basis = [np.eye(k, dtype=np.int64)[i] * min(capacity // int(width[i]), max(1, int(need[i]))) for i in range(k)]
    inverse = np.linalg.inv(np.array(basis, float).T)
    for step in range(rounds):
        price = inverse.sum(axis=0)
        gain, column = _best_filling(price, width, capacity)
        if gain <= 1 + 1e-7:
            break
        amounts, direction = inverse @ need, inverse @ column
        up = direction > 1e-9
        ratio = np.where(up, amounts / np.where(up, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[out] = column
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
        if step % 50 == 49:
            inverse = np.linalg.inv(np.array(basis, float).T)
    else:
        warnings.warn(f"the programme over configurations was not solved in {rounds} rounds", RuntimeWarning, stacklevel=2)
    amounts = np.floor(np.maximum(inverse @ need, 0) + 1e-6).astype(np.int64)
    plan, left = [], need.astype(np.int64).copy()
    for column, times in zip(basis, amounts):
        while times > 0 and (column * times > left).any():
            times -= 1
        if times:
            plan.append((int(times), column))
            left = left - column * times
    while left.any():
        column, room = np.zeros(k, np.int64), capacity
        for i in np.argsort(-width):
            m = min(int(left[i]), room // int(width[i]))
            column[i], room = m, room - m * int(width[i])
        times = int(min(left[i] // column[i] for i in range(k) if column[i]))
        plan.append((times, column))
        left = left - column * times
    return plan


def plan_large(sizes: np.ndarray, counts: np.ndarray, first_rank: int, capacity: int, groups: int) -> tuple[pd.DataFrame, int]:
    """Where items of each rank go: rows (lo, hi, base, times), and the number of containers.

    sizes rise; ranks count from first_rank in that order. Groups of equal cardinality are
    rounded up to their largest size; equal sizes that result are one.
    """
    total = int(counts.sum())
    if not total:
        return pd.DataFrame({"lo": [], "hi": [], "base": [], "times": []}, dtype=np.int64), 0
    upto = np.cumsum(counts)
    cuts = np.unique(np.ceil(np.arange(1, groups + 1) * total / groups).astype(np.int64))
    width = sizes[np.searchsorted(upto, cuts)]
    last = np.append(width[1:] != width[:-1], True)
    width, cuts = width[last], cuts[last]
    need = np.diff(np.append(0, cuts))
    rows, base = [], 0
    start = np.append(0, cuts[:-1]) + first_rank
    for times, column in configurations(width, need, capacity):
        for i in np.flatnonzero(column):
            rows.append((start[i], start[i] + column[i] * times, base, times))
            start[i] += column[i] * times
        base += times
    return pd.DataFrame(rows, columns=["lo", "hi", "base", "times"]).sort_values("lo", ignore_index=True).astype(np.int64), base


def plan_small(sizes: np.ndarray, counts: np.ndarray, free: dict[int, int], capacity: int, base: int) -> tuple[pd.DataFrame, int]:
    """Best fit of small items: rows (lo, hi, room, at), and the number of containers then.

    Items of rank lo..hi go one each to the containers that had `room` left and stand at
    position `at` and following among those; room -1: to new containers numbered from `at`.
    sizes rise, ranks count from 0; free: containers by the room they have left.
    """
    cohorts: dict[int, list[tuple[int, int, int]]] = {r: [(r, 0, n)] for r, n in free.items() if r > 0 and n > 0}
    rows, end = [], np.cumsum(counts)
    for s, n, hi in zip(sizes[::-1].tolist(), counts[::-1].tolist(), end[::-1].tolist()):
        rank = hi - n
        rooms = sorted((r for r, c in cohorts.items() if r >= s and c), reverse=True)
        while n:
            while rooms and not cohorts[rooms[-1]]:
                rooms.pop()
            if rooms:
                r = rooms[-1]
                room, at, size = cohorts[r].pop()
            else:
                r, room, at, size = capacity, -1, base, -(-n // (capacity // s))
                base += size
            # equal items fill the tightest container as far as they go, then the next
            each = r // s
            whole = min(size, n // each)
            layers, wide = (each, whole) if whole else (n, 1)
            for _ in range(layers):
                rows.append((rank, rank + wide, room, at))
                rank += wide
            n -= layers * wide
            if wide < size:
                cohorts.setdefault(r, []).append((room, at + wide, size - wide))
                if not rooms:
                    rooms = [r]
            cohorts.setdefault(r - layers * s, []).append((room, at, wide))
    return pd.DataFrame(rows, columns=["lo", "hi", "room", "at"]).sort_values("lo", ignore_index=True).astype(np.int64), base


def pack_items(sizes: DataFrame, item: str = "doc_id", size: str = "n_tokens", capacity: int = 2048, groups: int = 96, small: int | None = None) -> DataFrame:
    """(container_id, item, piece_no, piece_start, piece_size): every item in containers of capacity.

    An item no larger than the capacity lies whole in one container. A larger one gives as
    many full containers as it fills, and a last piece that is packed like an item. Items of
    size 0, null size counted as 0, take no room and are spread over the containers. Rows
    with a null item are dropped; repeated rows are items of their own; other columns don't
    matter; an empty table gives an empty result.

    Linear grouping: items above small (a third of the capacity), in order of size, are cut into groups of equal
    cardinality and rounded up to each group's largest; the linear programme over
    configurations of these few sizes is solved on the driver; the items themselves, by
    their rank, take the places planned for their group; and the small ones go best-fit into
    the room that is really left then, and into new containers. The driver sees histograms
    only: at most capacity rows of sizes and of room left, whatever the data. Items and
    containers are ranked by range partitioning, and meet by rank.
    """
    small = capacity // 3 if small is None else small
    amount = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    rows = materialize(sizes.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), amount.alias("size")), "sizes")
    over = F.col("size") > capacity
    whole = F.when(over, F.floor(F.col("size") / capacity)).otherwise(F.lit(0)).cast("long")
    rest = rows.select("item", whole.alias("piece_no"), (F.col("size") - whole * capacity).alias("s")).where("s > 0")
    items = global_rank(rest, ["s", "item"], "items")

    hist = items.groupBy("s").agg(F.count(F.lit(1)).alias("n")).orderBy("s").toPandas()  # at most capacity rows
    s, n = hist["s"].to_numpy(np.int64), hist["n"].to_numpy(np.int64)
    low = s <= small
    n_small = int(n[low].sum())
    large_plan, containers = plan_large(s[~low], n[~low], n_small, capacity, groups)
    lo, base, times = (large_plan[c].to_numpy() for c in ("lo", "base", "times"))

    @F.pandas_udf(T.LongType())
    def container_of(rank: pd.Series) -> pd.Series:
        k = np.searchsorted(lo, rank.to_numpy(), side="right") - 1
        return pd.Series(base[k] + (rank.to_numpy() - lo[k]) % times[k])

    large = materialize(items.where(F.col("rank") >= n_small).select("item", "piece_no", "s", container_of("rank").alias("container_id")), "large")

    room = large.groupBy("container_id").agg((F.lit(capacity) - F.sum("s")).alias("room"))
    room = global_rank(room, ["room", "container_id"], "room")
    left = room.groupBy("room").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")).toPandas()  # at most capacity rows
    first = dict(zip(left["room"].tolist(), left["first"].tolist()))
    used = containers  # all of these hold something
    small_plan, containers = plan_small(s[low], n[low], dict(zip(left["room"].tolist(), left["n"].tolist())), capacity, containers)
    slo, at = small_plan["lo"].to_numpy(), small_plan["at"].to_numpy()
    # places in the order of room: where the class begins, and on from there; new containers below 0
    fresh = (small_plan["room"] < 0).to_numpy()
    begin = np.array([0 if r < 0 else first[r] for r in small_plan["room"].tolist()], np.int64)

    @F.pandas_udf(T.LongType())
    def place_of(rank: pd.Series) -> pd.Series:
        k = np.searchsorted(slo, rank.to_numpy(), side="right") - 1
        step = at[k] + rank.to_numpy() - slo[k]
        return pd.Series(np.where(fresh[k], -1 - step, begin[k] + step))

    places = items.where(F.col("rank") < n_small).select("item", "piece_no", "s", place_of("rank").alias("place"))
    known = room.select(F.col("rank").alias("place"), F.col("container_id"))
    tiny = places.join(known, "place", "left").select("item", "piece_no", "s", F.coalesce("container_id", -1 - F.col("place")).alias("container_id"))

    full = rows.where(over).select("item", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece_no"))
    full = global_rank(full, ["item", "piece_no"], "full").select("item", "piece_no", F.lit(capacity).cast("long").alias("s"), (F.col("rank") + containers).alias("container_id"))
    none = rows.where("size = 0").select("item", F.lit(0).cast("long").alias("piece_no"), F.lit(0).cast("long").alias("s"), F.pmod(F.xxhash64("item"), F.lit(max(1, used or containers))).alias("container_id"))
    packed = large.select("item", "piece_no", "s", "container_id").unionByName(tiny).unionByName(full).unionByName(none)
    return packed.select("container_id", F.col("item").alias(item), "piece_no", (F.col("piece_no") * capacity).alias("piece_start"), F.col("s").alias("piece_size"))

"""A sweep over points and intervals in time.

Each block of time of a key is swept once: intervals enter when they begin to count and are dropped,
lazily, when they have ended, so n points and m intervals take (n + m) log (n + m) steps and no
pair of them is made. What reaches over the border of a block is carried as a few rows.
"""

from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.session import stored


def _nearest_open(times: list[int], starts: list[int], lows: list[int], highs: list[int],
                  idents: list) -> list[tuple | None]:
    """For each time, ascending, (gap, id) of the interval that is open then and starts nearest.

    Two heaps hold the open intervals: those started, latest first, and those still ahead,
    earliest first. An interval at the top that has ended, or has started meanwhile, is never
    wanted again and goes.
    """
    enter = sorted(range(len(starts)), key=lambda i: lows[i])
    begin = sorted(range(len(starts)), key=lambda i: max(lows[i], starts[i]))
    ahead: list[tuple] = []
    behind: list[tuple] = []
    entered = begun = 0
    out: list[tuple | None] = []
    for t in times:
        while entered < len(enter) and lows[enter[entered]] <= t:
            i = enter[entered]
            entered += 1
            if starts[i] > t and highs[i] >= t:
                heappush(ahead, (starts[i], idents[i], highs[i]))
        while begun < len(begin) and max(lows[begin[begun]], starts[begin[begun]]) <= t:
            i = begin[begun]
            begun += 1
            if highs[i] >= t:
                heappush(behind, (-starts[i], idents[i], highs[i]))
        while ahead and (ahead[0][0] <= t or ahead[0][2] < t):
            heappop(ahead)
        while behind and behind[0][2] < t:
            heappop(behind)
        found = [(t + behind[0][0], behind[0][1])] if behind else []
        if ahead:
            found.append((ahead[0][0] - t, ahead[0][1]))
        out.append(min(found) if found else None)
    return out


def _nearest_start(t: int, starts: list[int], idents: list) -> tuple:
    """(gap, id) of the nearest of the distinct sorted starts; the smaller id of equal gaps."""
    at = bisect_right(starts, t)
    near = [(abs(starts[i] - t), idents[i]) for i in (at - 1, at) if 0 <= i < len(starts)]
    return min(near)


def sweep_block(block: pa.Table) -> tuple[np.ndarray, list, list, list]:
    """Which rows of a block are points, and the interval, covered flag and gap of each.

    Rows with a null _at are points at _time; the others are intervals that start at _at and cover
    _lo to _hi, if these are not null.
    """
    at = block.column("_at").to_pylist()
    points = [i for i, start in enumerate(at) if start is None]
    ivs = [i for i, start in enumerate(at) if start is not None]
    if not ivs or not points:
        return np.array([], np.int64), [], [], []
    times = block.column("_time").take(points).to_pylist()
    lo, hi, idents = (block.column(c).take(ivs).to_pylist() for c in ("_lo", "_hi", "_ident"))
    starts = [at[i] for i in ivs]
    order = sorted(range(len(points)), key=times.__getitem__)
    cover = [i for i in range(len(ivs)) if lo[i] is not None]
    open_ = _nearest_open([times[i] for i in order], *([values[i] for i in cover] for values in (starts, lo, hi, idents)))
    least: dict[int, object] = {}
    for start, ident in zip(starts, idents):
        least[start] = min(ident, least.get(start, ident))
    distinct = sorted(least)
    least_ids = [least[s] for s in distinct]
    chosen = [found or _nearest_start(times[i], distinct, least_ids) for i, found in zip(order, open_)]
    return (np.array([points[i] for i in order], np.int64), [ident for _, ident in chosen],
            [found is not None for found in open_], [gap for gap, _ in chosen])


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each block, which lie together; one block at a time is held."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        changed = np.zeros(len(table), bool)
        for key in keys:
            values = table.column(key).combine_chunks()
            changed[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(changed).tolist(), len(table)]
        for start, end in zip(cuts, cuts[1:]):
            own = tuple(table.column(key)[start].as_py() for key in keys)
            if own != last and held:
                yield pa.concat_tables(held)
                held = []
            last = own
            held.append(table.slice(start, end - start))
    if held:
        yield pa.concat_tables(held)


def _block_of(micros: Column, width: int) -> Column:
    return ((micros - F.pmod(micros, F.lit(width))) / F.lit(width)).cast("long")


def nearest_intervals(points: DataFrame, intervals: DataFrame, key: str, ts: str, interval_id: str,
                      start: str, end: str, grace_micros: int, block_hours: int) -> DataFrame:
    """The points with interval_id, covered and _gap (microseconds to its start): see `timejoin.assign_interval`.

    Rows of one key and block of `block_hours` meet in one task. An interval goes to the blocks in
    which it begins to count, starts and ends. Of the intervals that cover a whole block, the latest
    started and the earliest to start decide; of all other ones the last start before the block and the first one
    after it. Those are single rows, found by aggregates and one window over a key's blocks.
    """
    width = block_hours * 3_600_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    lo, hi = F.col("_at") - grace_micros, micros(end) + grace_micros
    covers = lambda c: F.when(lo <= hi, c)
    ivs = stored(
        intervals.where(F.col(start).isNotNull() & F.col(key).isNotNull() & F.col(interval_id).isNotNull())
        .withColumn("_at", micros(start)).groupBy(F.col(key).alias("_key"), "_at", F.col(end))
        .agg(F.min(interval_id).alias("_ident"))
        .select("_key", "_at", covers(lo).alias("_lo"), covers(hi).alias("_hi"), "_ident"), "intervals")

    at_block, lo_block, hi_block = (_block_of(F.col(c), width) for c in ("_at", "_lo", "_hi"))
    ends = ivs.select("*", F.explode(F.array_distinct(F.array(
        at_block, F.coalesce(lo_block, at_block), F.coalesce(hi_block, at_block)))).alias("_block"))
    inner = ivs.where("_lo IS NOT NULL").select(
        "_key", "_at", "_ident", at_block.alias("_own"),
        F.explode(F.filter(F.sequence(lo_block, hi_block), lambda n: (n > lo_block) & (n < hi_block) & (n != at_block)))
        .alias("_block"))
    started = F.col("_own") < F.col("_block")
    behind, ahead = F.when(started, F.col("_at")), F.when(~started, F.col("_at"))
    # the smaller id where starts are equal; then one start each way
    whole = inner.groupBy("_key", "_block", "_own", "_at").agg(F.min("_ident").alias("_ident")).groupBy("_key", "_block").agg(
        F.max(behind).alias("_b"), F.max_by("_ident", behind).alias("_bi"),
        F.min(ahead).alias("_a"), F.min_by("_ident", ahead).alias("_ai"))
    first, last = F.col("_block") * width, F.col("_block") * width + (width - 1)
    whole = whole.select("_key", "_block", F.explode(F.array(*[
        F.struct(F.col(c).alias("_at"), first.alias("_lo"), last.alias("_hi"), F.col(i).alias("_ident"))
        for c, i in (("_b", "_bi"), ("_a", "_ai"))])).alias("_iv")).where("_iv._at IS NOT NULL").select("_key", "_block", "_iv.*")

    known = points.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).withColumns(
        {"_key": F.col(key), "_time": micros(ts)}).withColumn("_block", _block_of(F.col("_time"), width))
    starts = ivs.groupBy("_key", "_at").agg(F.min("_ident").alias("_ident")).withColumn("_block", at_block)
    starts = starts.groupBy("_key", "_block").agg(
        F.min("_at").alias("_e"), F.min_by("_ident", "_at").alias("_ei"), F.max("_at").alias("_l"), F.max_by("_ident", "_at").alias("_li"))
    seen = known.groupBy("_key", "_block").agg(F.lit(True).alias("_seen"))
    by_block = Window.partitionBy("_key").orderBy("_block")
    over = by_block.rowsBetween(Window.unboundedPreceding, -1), by_block.rowsBetween(1, Window.unboundedFollowing)
    around = starts.join(seen, ["_key", "_block"], "full").select(
        "_key", "_block", "_seen",
        F.struct(F.last("_l", True).over(over[0]).alias("_at"), F.last("_li", True).over(over[0]).alias("_ident")).alias("_p"),
        F.struct(F.first("_e", True).over(over[1]).alias("_at"), F.first("_ei", True).over(over[1]).alias("_ident")).alias("_n"))
    around = around.where("_seen").select("_key", "_block", F.explode(F.array("_p", "_n")).alias("_iv")).where(
        "_iv._at IS NOT NULL").select("_key", "_block", "_iv.*")

    columns = [c for c in points.columns if c not in (interval_id, "covered")]
    # named by place, so that columns of any name can come along
    rows = known.select("_key", "_block", "_time", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    for side in (ends, whole, around):
        rows = rows.unionByName(side, allowMissingColumns=True)
    names = [f"c{i}" for i in range(len(columns))]
    rows = rows.select("_key", "_block", "_time", "_at", "_lo", "_hi", "_ident", *names)
    rows = rows.repartition("_key", "_block").sortWithinPartitions("_key", "_block")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, ["_key", "_block"]):
            at, idents, covered, gaps = sweep_block(block)
            if len(at):
                kept = block.select(names).take(pa.array(at))
                kept = kept.append_column("_ident", pa.array(idents, block.schema.field("_ident").type))
                kept = kept.append_column("_covered", pa.array(covered)).append_column("_gap", pa.array(gaps, pa.int64()))
                yield from kept.combine_chunks().to_batches()

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in [*names, "_ident"]) + ", _covered boolean, _gap long"
    return rows.mapInArrow(sweep, schema).select(
        *[F.col(n).alias(c) for n, c in zip(names, columns)], F.col("_ident").alias(interval_id),
        F.col("_covered").alias("covered"), "_gap")

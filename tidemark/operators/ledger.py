"""Trade accounting on recorded decisions and fills."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.prices import clamp
from tidemark.schema import parts_for, stored

LEAST = 1e-9


def fill_price(bid: Column, ask: Column, bid_size: Column, ask_size: Column, delta: Column, impact_bps: float) -> Column:
    """Touch price moved by impact_bps for each resting size taken (at most five; one where none rests)."""
    buy = delta > 0
    resting = F.when(buy, ask_size).otherwise(bid_size)
    share = F.when(resting > 0, F.abs(delta) / resting).otherwise(1.0)
    return F.when(buy, ask).otherwise(bid) * (1 + F.when(buy, 1.0).otherwise(-1.0) * impact_bps * F.least(share, F.lit(5.0)) / 1e4)


def arrivals(decisions: DataFrame, latency_us: Column, interval_us: int) -> DataFrame:
    """decisions with `arrival`, the seq at which they take effect: at least one tick on."""
    return decisions.withColumn("arrival", F.col("seq") + F.greatest(F.lit(1), F.ceil(latency_us / interval_us)).cast("long"))


def target_fills(targets: DataFrame, ticks: DataFrame, impact_bps: float = 2.0, fee_bps: float = 1.0, keys: tuple[str, ...] = ("run", "symbol")) -> DataFrame:
    """Fills (keys, seq, ts_us, delta, price, fee) of targets (keys, seq, target) at the ticks of their seq.

    With all targets known, the position before one is the target before it; changes below 1e-9 don't trade.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    rows = targets.withColumn("delta", F.col("target") - F.coalesce(F.lag("target").over(w), F.lit(0.0))).filter(F.abs("delta") >= LEAST)
    rows = rows.join(ticks.select("symbol", "seq", "ts_us", "bid", "ask", "bid_size", "ask_size"), ["symbol", "seq"])
    rows = rows.withColumn("price", fill_price(F.col("bid"), F.col("ask"), F.col("bid_size"), F.col("ask_size"), F.col("delta"), impact_bps))
    return rows.select(*keys, "seq", "ts_us", "delta", "price", (F.col("price") * F.abs("delta") * fee_bps / 1e4).alias("fee"))


def cost_fold(rows: DataFrame, parts: tuple[str, ...], every: bool, tasks: int | None = None) -> DataFrame:
    """rows (parts, seq, delta, price, fee, and the state before a part: u, avg, realized0, fees0) in order of seq through the average-cost step, each part for itself.

    With u given, every step is affine in the average price before the part: the average is
    a * avg + b, what was realised r0 + r1 * avg. every: the state after each row; else a row of
    (a, b, r0, r1, fees) for each part.
    """
    names = [*parts, "seq", "delta", "price", "fee"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, u, a, b, r0, r1, fees = None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = tuple(row[: len(parts)])
                if own != part:
                    if not every and part is not None:
                        out.append((*part, a, b, r0, r1, fees))
                    part, u = own, row.u
                    a, b, r0, r1, fees = (0.0, row.avg, row.realized0, 0.0, row.fees0) if every else (1.0, 0.0, 0.0, 0.0, 0.0)
                delta, price = row.delta, row.price
                if u == 0 or (u > 0) == (delta > 0):
                    if delta:
                        a, b = a * abs(u) / (abs(u) + abs(delta)), (b * abs(u) + price * abs(delta)) / (abs(u) + abs(delta))
                else:
                    closed = min(abs(u), abs(delta)) * (1 if u > 0 else -1)
                    r0, r1 = r0 + (price - b) * closed, r1 - a * closed
                    if abs(delta) > abs(u):
                        a, b = 0.0, price
                u += delta
                if abs(u) < LEAST:
                    u = a = b = 0.0
                fees += row.fee
                if every:
                    out.append((*row[: len(names)], u, b, r0, fees))
            yield pd.DataFrame(out, columns=[*names, "units", "avg_price", "realized", "fees"] if every else [*parts, "a", "b", "r0", "r1", "fees"])
        if not every and part is not None:
            yield pd.DataFrame([(*part, a, b, r0, r1, fees)], columns=[*parts, "a", "b", "r0", "r1", "fees"])

    given = rows.select(*names if every else parts).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    added = "units double, avg_price double, realized double, fees double" if every else "a double, b double, r0 double, r1 double, fees double"
    before = ["u", "avg", "realized0", "fees0"] if every else ["u"]
    return rows.select(*names, *before).repartition(*([tasks] if tasks else []), *parts).sortWithinPartitions(*parts, "seq").mapInPandas(run, f"{given}, {added}")


def ledger(fills: DataFrame, keys: tuple[str, ...] = ("run", "symbol"), block: int = 65536, last: bool = False) -> DataFrame:
    """fills (keys, seq, delta, price, fee) with units, avg_price, realized and fees after each: average cost.

    Adding averages the price, reducing realises against it, going through flat starts again at the
    fill's price. A key's history is cut into blocks of seq, which are folded in parallel: running sums
    give the units before each block, a first fold each block's effect on the average price and the
    realised sum (but for a key's last block), those are chained, one row a block, and a second fold
    starts each block from its state. Deltas are summed as decimals of twelve places, so that blocks
    agree on where a position is flat. last: the rows of each key's last block only.
    """
    rows = fills.select(*keys, "seq", "delta", "price", "fee").withColumn("_b", F.floor(F.col("seq") / block))
    parts, order = (*keys, "_b"), Window.partitionBy(*keys).orderBy("_b")
    sums = rows.groupBy(*parts).agg(F.sum(F.col("delta").cast("decimal(38,12)")).alias("_d"))
    units = F.coalesce(F.sum("_d").over(order.rowsBetween(Window.unboundedPreceding, -1)).cast("double"), F.lit(0.0))
    blocks = stored(sums.select(*parts, F.when(F.abs(units) < LEAST, 0.0).otherwise(units).alias("u"), F.lead("_b").over(order).isNull().alias("_last")))
    tasks = parts_for(fills.sparkSession, blocks.count() * block)  # a part holds some eight blocks

    def joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        right = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(parts)], *[c for c in right.columns if c not in parts])
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(parts)]
        return left.join(right, same, how).drop(*[f"_k{i}" for i in range(len(parts))])

    effects = cost_fold(joined(rows, blocks.filter(~F.col("_last"))), parts, every=False, tasks=tasks)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, avg, realized, fees = None, 0.0, 0.0, 0.0
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = tuple(row[: len(keys)])
                if own != key:
                    key, avg, realized, fees = own, 0.0, 0.0, 0.0
                out.append((*row[: len(parts)], row.u, avg if row.u else 0.0, realized, fees))
                if not row.last:
                    avg, realized, fees = row.a * avg + row.b, realized + row.r0 + row.r1 * avg, fees + row.fees
            yield pd.DataFrame(out, columns=[*parts, "u", "avg", "realized0", "fees0"])

    linked = joined(blocks, effects, "left").select(*parts, "u", F.col("_last").alias("last"), "a", "b", "r0", "r1", "fees")
    given = blocks.select(*parts).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    states = linked.repartition(*keys).sortWithinPartitions(*parts).mapInPandas(chain, f"{given}, u double, avg double, realized0 double, fees0 double")
    if last:
        states = joined(states, blocks.filter("_last").select(*parts))
    return cost_fold(joined(rows, states), parts, every=True, tasks=tasks).drop("_b")


def marked(book: DataFrame, ticks: DataFrame, keys: tuple[str, ...] = ("run", "symbol")) -> DataFrame:
    """ticks of each run with unrealized, gross and equity (net of fees), from the last ledger row at or before each."""
    runs = book.select(*keys).distinct()
    rows = ticks.select("symbol", "seq", "mid").join(runs, "symbol").select(*keys, "seq", "mid", F.lit(None).cast("struct<units:double,avg_price:double,realized:double,fees:double>").alias("_s"), F.lit(1).alias("_k"))
    fills = book.select(*keys, "seq", F.lit(None).cast("double").alias("mid"), F.struct("units", "avg_price", "realized", "fees").alias("_s"), F.lit(0).alias("_k"))
    both = rows.unionByName(fills).withColumn("_b", F.floor(F.col("seq") / 65536))
    ends = both.groupBy(*keys, "_b").agg(F.max_by("_s", F.when(F.col("_k") == 0, F.col("seq"))).alias("_end"))
    ends = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    own = Window.partitionBy(*keys, "_b").orderBy("seq", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = both.join(ends, [*keys, "_b"]).withColumn("_s", F.coalesce(F.last("_s", ignorenulls=True).over(own), F.col("_carry"))).filter("_k = 1")
    unrealized = F.coalesce((F.col("mid") - F.col("_s.avg_price")) * F.col("_s.units"), F.lit(0.0))
    gross = F.coalesce(F.col("_s.realized"), F.lit(0.0)) + unrealized
    return both.select(*keys, "seq", "mid", F.coalesce(F.col("_s.units"), F.lit(0.0)).alias("units"), unrealized.alias("unrealized"), gross.alias("gross"), (gross - F.coalesce(F.col("_s.fees"), F.lit(0.0))).alias("equity"), F.col("_s.avg_price").alias("avg_price"))


def excursion_flags(equity: DataFrame, vol_bps: Column, stop_bps: float = 25.0) -> DataFrame:
    """A marked curve with the open position's move in bps of its entry, in vols, and the stop flag; no move is told of an entry at zero.

    The entry is the curve's avg_price; without that column it follows from what is unrealized.
    """
    entry = F.col("avg_price") if "avg_price" in equity.columns else F.col("mid") - F.col("unrealized") / F.nullif(F.col("units"), F.lit(0.0))
    bps = F.coalesce(F.when(F.col("units") != 0, (F.col("mid") - entry) / F.nullif(entry, F.lit(0.0)) * 1e4 * F.signum("units")), F.lit(0.0))
    return equity.withColumn("excursion_bps", bps).withColumn("excursion_vols", bps / F.greatest(vol_bps, F.lit(1e-9))).withColumn("stop", F.col("excursion_bps") <= -stop_bps)


def folded(rows: DataFrame, keys: tuple[str, ...], start: dict, step, schema: str) -> DataFrame:
    """rows in order of seq per key through step(state, row) -> values: the shape of every order-dependent rule."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, dict(start)
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                own = tuple(getattr(row, k) for k in keys)
                if own != key:
                    key, state = own, dict(start)
                out.append((*row, *step(state, row)))
            yield pd.DataFrame(out, columns=[*names, *[c.split()[0] for c in schema.split(", ")]])

    given = rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInPandas(run, f"{given}, {schema}")


def block_folded(rows: DataFrame, keys: tuple[str, ...], start: float, summarise, enter, step, schema: str, block: int = 65536) -> DataFrame:
    """folded() for rules of one number, a key's blocks in parallel: what a block does to any number it may start with is found alone, blocks are chained, and each is replayed.

    summarise(rows of a block) -> [(xs, outs), ..], two lists of numbers for each stretch of it;
    enter(state, xs, outs) -> the state after that stretch; step(state, row) -> (state, values). Only a
    row for each stretch meets in one task.
    """
    parts = [*keys, "_b"]
    given = rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    named = rows.select(*parts[:-1]).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    cut = rows.withColumn("_b", F.floor(F.col("seq") / block))
    dealt = cut.repartition(*parts).sortWithinPartitions(*parts, "seq")

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(own: tuple, held: list) -> list[tuple]:
            return [(*own, i, xs, outs) for i, (xs, outs) in enumerate(summarise(held))]

        own, held, out = None, [], []
        for b in batches:
            for row in b.itertuples(index=False):
                at = tuple(getattr(row, k) for k in keys) + (row[-1],)
                if at != own:
                    out += told(own, held) if held else []
                    own, held = at, []
                held.append(row)
        out += told(own, held) if held else []
        yield pd.DataFrame(out, columns=[*parts, "_i", "xs", "outs"])

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, start
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                if tuple(row[: len(keys)]) != key:
                    key, state = tuple(row[: len(keys)]), start
                if row[len(keys) + 1] == 0:
                    out.append((*row[: len(keys) + 1], state))
                state = enter(state, row.xs, row.outs)
            yield pd.DataFrame(out, columns=[*parts, "_start"])

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state = None, start
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                at = tuple(getattr(row, k) for k in keys) + (row[-2],)
                if at != own:
                    own, state = at, row[-1]
                state, values = step(state, row)
                out.append((*row[: len(names)], *values))
            yield pd.DataFrame(out, columns=[*names, *[c.split()[0] for c in schema.split(", ")]])

    names = rows.columns
    stretches = dealt.mapInPandas(maps, f"{named}, _b long, _i int, xs array<double>, outs array<double>")
    states = stretches.repartition(*keys).sortWithinPartitions(*parts, "_i").mapInPandas(chain, f"{named}, _b long, _start double")
    right = states.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(parts)], "_start")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(parts)]
    known = cut.join(right, same).select(*names, "_b", "_start")
    return known.repartition(*parts).sortWithinPartitions(*parts, "seq").mapInPandas(replay, f"{given}, {schema}")


#: A stretch of a block ends where its map would have more pieces than this.
PIECES = 256


def dead_band(ideals: DataFrame, band: float = 0.18, cap: float = 1.0, always_flat: bool = True, keys: tuple[str, ...] = ("run", "symbol"), block: int = 65536, pieces: int = PIECES) -> DataFrame:
    """ideals (keys, seq, ideal) with `target`: changes below band * cap keep the position, but going flat is always allowed.

    A start position is kept until the first ideal that it moves to, and only an ideal beyond all before it
    can be that one. So a block's map is a list of such ideals, each with what the position is at the
    block's end if it is taken; positions that take the same ideal later on are one from there.
    """
    width = band * cap

    def moves(x: float, p: float) -> bool:
        return abs(x - p) >= width or (always_flat and x == 0.0 and p != 0.0)

    def summarise(held: list) -> list:
        out, firsts, groups, low, high, flat = [], [], {}, None, None, False
        for row in held:
            x = float(row.ideal)
            moving = [v for v in groups if moves(x, v)]
            if moving:
                joined = [i for v in moving for i in groups.pop(v)]
                groups.setdefault(x, []).extend(joined)
            if low is None or x < low or x > high or (always_flat and x == 0.0 and not flat):
                groups.setdefault(x, []).append(len(firsts))
                firsts.append(x)
                low, high, flat = x if low is None else min(low, x), x if high is None else max(high, x), flat or x == 0.0
            if len(firsts) >= pieces:
                out.append((firsts, groups))
                firsts, groups, low, high, flat = [], {}, None, None, False
        if firsts:
            out.append((firsts, groups))
        return [(xs, [v for _, v in sorted((i, v) for v, own in g.items() for i in own)]) for xs, g in out]

    def enter(p: float, xs, outs) -> float:
        return next((float(o) for x, o in zip(xs, outs, strict=True) if moves(x, p)), p)

    def step(p: float, row):
        p = float(row.ideal) if moves(row.ideal, p) else p
        return p, (p,)

    return block_folded(ideals, keys, 0.0, summarise, enter, step, "target double", block)


def admitted(requests: DataFrame, cadence: int = 1, deadline_us: int = 2_000_000, interval_us: int = 1_000_000, keys: tuple[str, ...] = ("run", "symbol"), block: int = 65536) -> DataFrame:
    """requests (keys, seq, latency_us) with status: 'sent', 'busy' (one is in flight), 'off' (not at the cadence) or 'expired'.

    An expired request is dropped at its deadline and frees the line then. What a block starts with is for
    how long the line is still taken, a whole number up to the deadline's; a block's map says for each when
    the line is free at its end, and soon all agree.
    """
    most = max(1, -(-deadline_us // interval_us))

    def taken(seq: int, latency: int) -> int:
        return seq + max(1, -(-min(latency, deadline_us) // interval_us))

    def summarise(held: list) -> list:
        first = held[0].seq
        free = {first + d: [d] for d in range(most + 1)}  # when free -> the starts that lead there
        for row in held:
            if row.seq % cadence == 0:
                ready = [f for f in free if f <= row.seq]
                if ready:
                    joined = [d for f in ready for d in free.pop(f)]
                    free.setdefault(taken(row.seq, row.latency_us), []).extend(joined)
        return [([float(first)], [float(f) for _, f in sorted((d, f) for f, own in free.items() for d in own)])]

    def enter(state: float, xs, outs) -> float:
        return float(outs[min(most, max(0, int(state - xs[0])))])

    def step(state: float, row):
        if row.seq % cadence:
            return state, ("off",)
        if row.seq < state:
            return state, ("busy",)
        return float(taken(row.seq, row.latency_us)), ("expired" if row.latency_us > deadline_us else "sent",)

    return block_folded(requests, keys, -1.0, summarise, enter, step, "status string", block)


def quotes(rows: DataFrame, half_bps: float = 2.0, size: float = 1.0, most: float = 8.0, skew_bps: float = 2.5, widen: float = 0.35) -> DataFrame:
    """rows (mid, vol_bps, inventory, bid_spread_mult, ask_spread_mult, bid_size_mult, ask_size_mult) with quote bid, ask and sizes.

    Inventory moves both prices against itself; a side that would add to a full inventory has size 0.
    """
    at = F.col("mid") * (1 - clamp(F.col("inventory") / most, -1.0, 1.0) * skew_bps / 1e4)
    half = half_bps + widen * F.col("vol_bps")
    sized = lambda mult, full: F.greatest(F.lit(0.0), F.when(full, 0.0).otherwise(size * F.col(mult)))
    return (
        rows.withColumn("quote_bid", at * (1 - half * F.col("bid_spread_mult") / 1e4))
        .withColumn("quote_ask", at * (1 + half * F.col("ask_spread_mult") / 1e4))
        .withColumn("quote_bid_size", sized("bid_size_mult", F.col("inventory") >= most))
        .withColumn("quote_ask_size", sized("ask_size_mult", F.col("inventory") <= -most))
    )


def running_book(fills: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """fills (keys, seq, side, price, size) with inventory and cash after each: running sums over blocks plus the blocks before."""
    signed = F.col("side") * F.col("size")
    rows = fills.withColumn("_b", F.floor(F.col("seq") / 65536)).withColumn("_u", signed).withColumn("_c", -signed * F.col("price"))
    per = rows.groupBy(*keys, "_b").agg(F.sum("_u").alias("_su"), F.sum("_c").alias("_sc"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_b", F.coalesce(F.sum("_su").over(before), F.lit(0.0)).alias("_bu"), F.coalesce(F.sum("_sc").over(before), F.lit(0.0)).alias("_bc"))
    own = Window.partitionBy(*keys, "_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(per, [*keys, "_b"])
    return rows.withColumn("inventory", F.sum("_u").over(own) + F.col("_bu")).withColumn("cash", F.sum("_c").over(own) + F.col("_bc")).drop("_b", "_u", "_c", "_bu", "_bc")


def flow_imbalance(fills: DataFrame, last: int = 40) -> DataFrame:
    """fills (symbol, seq, side) with the mean side of the last `last` of them."""
    from tidemark.operators.features import blocked

    w = Window.partitionBy("symbol", "block").orderBy("seq").rowsBetween(1 - last, 0)
    return blocked(fills, halo=last).withColumn("flow", F.avg("side").over(w)).filter(~F.col("halo")).drop("block", "halo")

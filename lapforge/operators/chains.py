"""Sequential rules over ordered blocks in logarithmic rounds, without row-at-a-time Python.

A rule says what a block does to any state it is entered with: its transfer, a small table.
Transfers of neighbouring blocks are composed in groups of ``FAN``, the groups' transfers again,
until a key has one; then entry states go back down the same levels. A key of n blocks takes
about log(n) / log(FAN) rounds each way, whether its blocks depend on each other or not, and
every block runs twice: once for its transfer and once, entered rightly, for its output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.operators.ordered import B, G, Ordered
from lapforge.session import written

FAN = 256

Cols = dict[str, np.ndarray]


class Rule:
    """What a sequential rule needs to run in blocks.

    A state is a float (NaN before the first row); a transfer is an array of ``width`` columns.
    """

    inputs: Sequence[str] = ()
    outputs: dict[str, pa.DataType] = {}
    width = 1

    def transfer(self, cols: Cols) -> np.ndarray:
        """What the rows of one block do to an entry state."""
        raise NotImplementedError

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        """The transfer of two neighbours."""
        raise NotImplementedError

    def apply(self, transfer: np.ndarray, state: float) -> float:
        """The state a block is left with."""
        raise NotImplementedError

    def emit(self, cols: Cols, state: float) -> Cols:
        """Output columns of a block entered with ``state``."""
        raise NotImplementedError


# -- rules ---------------------------------------------------------------------------
def _chain_ends(after: np.ndarray) -> np.ndarray:
    """Last row of the chain that starts at each row; ``after`` is n where a chain ends."""
    n = len(after)
    at = np.where(after < n, after, np.arange(n))
    while True:
        further = at[at]
        if np.array_equal(further, at):
            return at
        at = further


def _chain(after: np.ndarray, start: int) -> np.ndarray:
    """Rows of the chain from ``start``, by pointer doubling."""
    n = len(after)
    jump = np.append(after, n)
    rows = np.array([start])
    while rows[0] < n and jump[rows[0]] < n:
        more = jump[rows]
        rows = np.concatenate([rows, more[more < n]])
        jump = jump[jump]
    return rows[rows < n]


def earliest(last: np.ndarray, gap: float, strict: bool) -> np.ndarray:
    """The least number x with ``x - last >= gap`` (or ``>``), as floats subtract."""
    fine = (lambda x: x - last > gap) if strict else (lambda x: x - last >= gap)
    x = last + gap
    for _ in range(4):
        lower = np.nextafter(x, -np.inf)
        x = np.where(fine(lower), lower, x)
    for _ in range(4):
        x = np.where(fine(x), x, np.nextafter(x, np.inf))
    return x


class Resume(Rule):
    """Keep the first candidate row, then each first one whose key reaches the last kept row's resume point.

    Keys must not fall along the order and a resume point lies above its own key. ``threshold``
    gives the resume points from the input columns; rows that are no ``candidate`` are passed over.
    The state is the resume point. A transfer lists, in order, the entry states up to which the
    exit is a certain one; a higher state passes through unchanged. Only states that earlier rows
    can leave matter: column ``_bound``, the highest of them, cuts the list.
    """

    outputs = {"_keep": pa.bool_()}
    width = 2

    def __init__(self, key: str, threshold: Callable[[Cols], np.ndarray], inputs: Sequence[str] = (), candidate: str | None = None):
        self.key, self.threshold, self.candidate = key, threshold, candidate
        self.inputs = list(dict.fromkeys([key, *inputs, *([candidate] if candidate else [])]))

    def _chains(self, cols: Cols):
        rows = np.flatnonzero(cols[self.candidate]) if self.candidate else np.arange(len(cols[self.key]))
        own = {c: v[rows] for c, v in cols.items()}
        keys, resume = own[self.key], self.threshold(own)
        after = np.maximum(np.searchsorted(keys, resume, "left"), np.arange(len(rows)) + 1)
        return rows, keys, resume, after

    def bound(self, cols: Cols) -> float:
        _, _, resume, _ = self._chains(cols)
        return float(resume.max()) if len(resume) else -np.inf

    def transfer(self, cols: Cols) -> np.ndarray:
        _, keys, resume, after = self._chains(cols)
        limit = cols["_bound"][0] if "_bound" in cols else np.inf
        used = min(len(keys), int(np.searchsorted(keys, limit, "left")) + 1)
        exits = resume[_chain_ends(after)] if len(keys) else resume
        table = np.stack([keys[:used], exits[:used]], axis=1)
        if used and keys[used - 1] >= limit:
            table[-1, 0] = np.inf  # no state comes through unchanged
        return self._short(table)

    @staticmethod
    def _short(table: np.ndarray) -> np.ndarray:
        """Equal exits of neighbours become one entry."""
        if len(table) < 2:
            return table
        last = np.append(table[1:, 1] != table[:-1, 1], True)
        return table[last]

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        if not len(first) or not len(then):
            return first if len(first) else then
        at = np.searchsorted(then[:, 0], first[:, 1], "left")
        exits = np.where(at < len(then), then[np.minimum(at, len(then) - 1), 1], first[:, 1])
        rest = then[then[:, 0] > first[-1, 0]]
        return self._short(np.concatenate([np.stack([first[:, 0], exits], axis=1), rest]))

    def apply(self, transfer: np.ndarray, state: float) -> float:
        state = -np.inf if np.isnan(state) else state
        at = int(np.searchsorted(transfer[:, 0], state, "left"))
        return float(transfer[at, 1]) if at < len(transfer) else state

    def emit(self, cols: Cols, state: float) -> Cols:
        rows, keys, _, after = self._chains(cols)
        keep = np.zeros(len(cols[self.key]), bool)
        start = int(np.searchsorted(keys, -np.inf if np.isnan(state) else state, "left"))
        if start < len(rows):
            keep[rows[_chain(after, start)]] = True
        return {"_keep": keep}


def spaced(key: str, gap: float, strict: bool) -> Resume:
    """Keep a row if it lies at least (``strict``: more than) ``gap`` after the last kept one."""
    return Resume(key, lambda cols: earliest(cols[key], gap, strict))


class Turned(Rule):
    """Mark a row once its value differs by ``turn`` or more from the value last marked.

    The first row only sets the value. The state is the last marked value; a transfer lists
    (from, exit): states from there up leave with ``exit``, or unchanged if it is NaN, and its
    first entry is what an unset state leaves with. Column ``_was``, the value before the block,
    bounds the states that matter.
    """

    outputs = {"lap_end": pa.bool_()}
    width = 2

    def __init__(self, value: str, turn: float):
        self.value, self.turn, self.inputs = value, turn, [value, "_was"]

    def _first(self, v: np.ndarray, state: np.ndarray, start: np.ndarray) -> np.ndarray:
        """First row from ``start`` on whose value is ``turn`` or more away from ``state``."""
        n = len(v)
        high, low, size = [v], [v], 1
        while 2 * size <= n:
            high.append(np.maximum(high[-1][:-size], high[-1][size:]))
            low.append(np.minimum(low[-1][:-size], low[-1][size:]))
            size *= 2
        at = start.copy()
        for level in range(len(high) - 1, -1, -1):
            size = 1 << level
            here = np.minimum(at, n - size)
            calm = (at + size <= n) & (np.abs(high[level][here] - state) < self.turn) & (np.abs(low[level][here] - state) < self.turn)
            at = np.where(calm, at + size, at)
        return at

    def _after(self, v: np.ndarray) -> np.ndarray:
        return self._first(v, v, np.arange(len(v)) + 1)

    def transfer(self, cols: Cols) -> np.ndarray:
        v, was = cols[self.value], cols["_was"][0]
        exits = v[_chain_ends(self._after(v))]
        lo, hi = (was - self.turn, was + self.turn) if was == was else (np.inf, np.inf)
        edges = np.concatenate([np.maximum.accumulate(v) - self.turn, np.minimum.accumulate(v) + self.turn])
        slack = 4 * np.spacing(np.abs(edges) + self.turn)  # differences round
        edges = np.unique(np.concatenate([edges - slack, edges + slack, [lo]]))
        edges = edges[(edges >= lo) & (edges < hi)]
        at = self._first(v, edges, np.zeros(len(edges), "int64"))
        leave = np.where(at < len(v), exits[np.minimum(at, len(v) - 1)], np.nan)
        return self._short(np.stack([np.append(-np.inf, edges), np.append(exits[0], leave)], axis=1))

    @staticmethod
    def _short(table: np.ndarray) -> np.ndarray:
        same = (table[1:, 1] == table[:-1, 1]) | (np.isnan(table[1:, 1]) & np.isnan(table[:-1, 1]))
        keep = np.append(True, ~same)
        keep[1:2] = True
        return table[keep]

    def _leave(self, table: np.ndarray, state: np.ndarray) -> np.ndarray:
        at = np.maximum(np.searchsorted(table[1:, 0], state, "right"), 1)
        got = table[np.minimum(at, len(table) - 1), 1]
        return np.where(np.isnan(got), state, got)

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        # Inside a stretch of ``first`` that passes states on, the edges of ``then`` matter.
        edges = np.unique(np.concatenate([first[1:, 0], then[1:, 0]]))
        edges = edges[edges >= first[1, 0]] if len(first) > 1 else edges[:0]
        at = np.searchsorted(first[1:, 0], edges, "right")
        middle = first[np.minimum(at, len(first) - 1), 1]
        idle = np.isnan(middle)
        into = np.where(idle, edges, middle)
        slot = np.searchsorted(then[1:, 0], into, "right")
        out = then[np.maximum(np.minimum(slot, len(then) - 1), 1), 1]
        leave = np.where(np.isnan(out), np.where(idle, np.nan, middle), out)
        unset = self._leave(then, np.array([first[0, 1]]))[0]
        return self._short(np.stack([np.append(-np.inf, edges), np.append(unset, leave)], axis=1))

    def apply(self, transfer: np.ndarray, state: float) -> float:
        return float(transfer[0, 1]) if np.isnan(state) else float(self._leave(transfer, np.array([state]))[0])

    def emit(self, cols: Cols, state: float) -> Cols:
        v = cols[self.value]
        done = np.zeros(len(v), bool)
        unset = np.isnan(state)
        start = 0 if unset else int(self._first(v, np.array([state]), np.zeros(1, "int64"))[0])
        if start < len(v):
            done[_chain(self._after(v), start)] = True
            done[0] &= not unset
        return {"lap_end": done}


class Decay(Rule):
    """Exponential mean: alpha * x + (1 - alpha) * state, seeded by the first value.

    A transfer is (factor, sum, first value): affine maps compose to one. A block is cut into
    stretches that step on side by side, each from the state that the maps before it lead to.
    """

    width = 3
    STRETCH = 512

    def __init__(self, col: str, alpha: float, name: str):
        self.col, self.alpha, self.inputs, self.outputs = col, alpha, [col], {name: pa.float64()}
        self.name = name

    def _steps(self, rows: np.ndarray, state: np.ndarray) -> np.ndarray:
        """All rows (stretches by places) from the states they start in."""
        out = np.empty_like(rows)
        for k in range(rows.shape[1]):
            state = self.alpha * rows[:, k] + (1 - self.alpha) * state
            out[:, k] = state
        return out

    def _run(self, x: np.ndarray, state: float) -> np.ndarray:
        """Means of a block; an unset state takes the first value as it is."""
        unset = np.isnan(state)
        head, x, state = (x[:1], x[1:], x[0]) if unset else (x[:0], x, state)
        whole = len(x) // self.STRETCH * self.STRETCH
        parts = [head]
        if whole:
            rows = x[:whole].reshape(-1, self.STRETCH)
            left = self._steps(rows, np.zeros(len(rows)))[:, -1]
            entry = np.empty(len(rows))
            for k, gain in enumerate(left):
                entry[k] = state
                state = (1 - self.alpha) ** self.STRETCH * state + gain
            done = self._steps(rows, entry)
            state = done[-1, -1]
            parts.append(done.ravel())
        parts.append(self._steps(x[whole:].reshape(1, -1), np.array([state])).ravel())
        return np.concatenate(parts)

    def transfer(self, cols: Cols) -> np.ndarray:
        x = cols[self.col]
        return np.array([[(1 - self.alpha) ** len(x), self._run(x, 0.0)[-1], x[0]]])

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        (f1, s1, x), (f2, s2, _) = first[0], then[0]
        return np.array([[f1 * f2, f2 * s1 + s2, x]])

    def apply(self, transfer: np.ndarray, state: float) -> float:
        factor, total, first = transfer[0]
        return float(factor * (first if np.isnan(state) else state) + total)

    def emit(self, cols: Cols, state: float) -> Cols:
        return {self.name: self._run(cols[self.col], state)}


class Automaton(Rule):
    """A machine of few states: ``table[state, symbol]`` is the next one; state 0 is the start.

    ``marks[state, symbol]`` is the output. A transfer maps every state; maps of rows are combined
    by doubling.
    """

    def __init__(self, symbol: str, table: np.ndarray, marks: np.ndarray, name: str):
        self.symbol, self.table, self.marks, self.name = symbol, table, marks, name
        self.inputs, self.outputs = [symbol], {name: pa.bool_()}

    def _maps(self, cols: Cols) -> np.ndarray:
        """State after each row for every entry state."""
        maps, reach = self.table[:, cols[self.symbol].astype("int64")].T.copy(), 1
        while reach < len(maps):
            maps = np.concatenate([maps[:reach], np.take_along_axis(maps[reach:], maps[:-reach], axis=1)])
            reach *= 2
        return maps

    def transfer(self, cols: Cols) -> np.ndarray:
        return self._maps(cols)[-1].astype("float64")[:, None]

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        return then[first[:, 0].astype("int64")]

    def apply(self, transfer: np.ndarray, state: float) -> float:
        return float(transfer[0 if np.isnan(state) else int(state), 0])

    def emit(self, cols: Cols, state: float) -> Cols:
        start = 0 if np.isnan(state) else int(state)
        before = np.append(start, self._maps(cols)[:-1, start])
        return {self.name: self.marks[before, cols[self.symbol].astype("int64")]}


# -- running them ----------------------------------------------------------------------
def _blocks(batches: Iterator[pa.RecordBatch], on: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the row each group starts at; groups are runs of equal ``on``.

    The last group of a batch may go on in the next one and waits for it, so at most one group
    and one batch are held.
    """
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in on:
            v = table.column(c).combine_chunks()
            step = pc.fill_null(pc.not_equal(v[1:], v[:-1]), True).to_numpy(zero_copy_only=False)
            null = v.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= np.where(null[1:] & null[:-1], False, step)
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if len(held) > 1 and not _continues(held[-2], batch, on):
            table = pa.Table.from_batches(held[:-1])
            yield table, cut(table)
            held = [batch]
        starts = cut(pa.Table.from_batches([batch]))
        if len(starts) > 1:
            keep = int(starts[-1])
            table = pa.Table.from_batches([*held[:-1], batch.slice(0, keep)])
            yield table, cut(table)
            held = [batch.slice(keep)]
    if held:
        table = pa.Table.from_batches(held)
        yield table, cut(table)


def _continues(a: pa.RecordBatch, b: pa.RecordBatch, on: Sequence[str]) -> bool:
    return all(a.column(c)[a.num_rows - 1].as_py() == b.column(c)[0].as_py() for c in on)


def _numbers(table: pa.Table, names: Sequence[str]) -> Cols:
    out = {}
    for c in names:
        v = table.column(c)
        out[c] = v.to_numpy(zero_copy_only=False).astype(bool) if pa.types.is_boolean(v.type) else np.asarray(v.to_numpy(zero_copy_only=False), dtype="float64")
    return out


def _spread(d: DataFrame, on: Sequence[str], *order: str) -> DataFrame:
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(n, *on).sortWithinPartitions(*on, *order)


def _per_block(d: DataFrame, on: Sequence[str], names: Sequence[str], fn: Callable[[Cols], np.ndarray], out: str = "_t") -> DataFrame:
    """``fn`` of every block as an array of numbers beside the block's keys."""
    schema = ", ".join([*[f"`{c}` {d.schema[c].dataType.simpleString()}" for c in on], f"{out} array<double>"])

    def run(batches):
        for table, starts in _blocks(batches, on):
            cols, ends = _numbers(table, names), np.append(starts[1:], table.num_rows)
            got = [fn({c: v[a:b] for c, v in cols.items()}).ravel() for a, b in zip(starts, ends)]
            keys = {c: table.column(c).take(pa.array(starts)).combine_chunks() for c in on}
            yield from pa.table({**keys, out: pa.array(got, pa.list_(pa.float64()))}).to_batches()

    return _spread(d.select(*on, G, *names), on, G).mapInArrow(run, schema)


def _entries(transfers: DataFrame, keys: Sequence[str], rule: Rule, fan: int) -> tuple[DataFrame, int]:
    """Entry state ``_entry`` of every block, and the number of rounds.

    ``transfers`` has one row ``_t`` per block, numbered by ``_n`` from 0 in its key. A group holds
    ``fan`` transfers at most.
    """
    def tables(group: pa.Table) -> list[np.ndarray]:
        return [np.asarray(v, "float64").reshape(-1, rule.width) for v in group.column("_t").to_pylist()]

    def same(group: pa.Table, rows: Sequence[int]) -> dict:
        return {k: group.column(k).take(pa.array(rows)).combine_chunks() for k in keys}

    def up(group: pa.Table) -> pa.Table:
        group = group.sort_by("_n")
        whole = None
        for t in tables(group):
            whole = t if whole is None else rule.compose(whole, t)
        n = group.column("_n")[0].as_py() // fan
        return pa.table({**same(group, [0]), "_n": pa.array([n], pa.int64()), "_t": pa.array([whole.ravel()], pa.list_(pa.float64()))})

    def down(group: pa.Table) -> pa.Table:
        group = group.sort_by("_n")
        state, entry = group.column("_entry")[0].as_py(), []
        state = np.nan if state is None else state
        for t in tables(group):
            entry.append(state)
            state = rule.apply(t, state)
        return pa.table({**same(group, range(len(entry))), "_n": group.column("_n").combine_chunks(), "_entry": pa.array(entry, pa.float64())})

    types = [f"`{k}` {transfers.schema[k].dataType.simpleString()}" for k in keys]
    part = F.expr(f"_n div {fan}").alias("_up")
    levels, most = [transfers], transfers.agg(F.max("_n").alias("n")).first()["n"] or 0
    while most >= fan:
        levels.append(written(levels[-1].groupBy(*keys, part).applyInArrow(up, ", ".join([*types, "_n long", "_t array<double>"])), "transfers"))
        most //= fan
    entry = levels[-1].select(*keys).distinct().withColumns({"_up": F.lit(0).cast("long"), "_entry": F.lit(float("nan"))})
    for level in reversed(levels):
        rows = level.withColumn("_up", F.expr(f"_n div {fan}")).join(entry, [*keys, "_up"])
        entry = written(rows.groupBy(*keys, "_up").applyInArrow(down, ", ".join([*types, "_n long", "_entry double"])), "entries")
        entry = entry.withColumnRenamed("_n", "_up")
    return entry.withColumnRenamed("_up", "_n"), 2 * len(levels) - 1


def _over_blocks(d: DataFrame, keys: Sequence[str], rows: int) -> Ordered:
    """One row per block, ordered by block: running values over them work in blocks again."""
    return Ordered(d.withColumnRenamed(B, G), keys, rows)


def run_rule(o: Ordered, rule: Rule) -> Ordered:
    """Add the rule's output columns to every row."""
    return counted(o, rule)[0]


def counted(o: Ordered, rule: Rule, fan: int = FAN) -> tuple[Ordered, int]:
    """``run_rule`` and the number of rounds over transfers that it took (0: no key has two blocks)."""
    keys = [f.name for f in o.df.schema if f.name in o.keys]
    on = [*keys, B]
    if isinstance(rule, Turned):
        o = o.lag(_was=F.col(rule.value))
    src = o.df.withColumn(B, F.expr(f"{G} div {o.rows}"))
    ends = src.groupBy(*keys).agg(F.min(B).alias("lo"), F.max(B).alias("hi"))
    rounds = 0
    many = ends.where("hi > lo")
    many = written(many.select(*keys), "keys") if keys else many
    if many.limit(1).count():
        # Keys inside one block are entered unset; the others are two for each block at most.
        slim, names = src.select(*on, G, *rule.inputs), list(rule.inputs)
        slim = slim.join(many, keys) if keys else slim
        if isinstance(rule, Resume):
            tops = written(_per_block(slim, on, names, lambda cols: np.array([rule.bound(cols)])), "bounds").select(*on, F.get("_t", F.lit(0)).alias("_top"))
            limit = _over_blocks(tops, keys, o.rows).running(exclusive=True, _bound=("max", "_top")).df.withColumnRenamed(G, B)
            slim = slim.join(limit.select(*on, F.coalesce("_bound", F.lit(float("-inf"))).alias("_bound")), on)
            names.append("_bound")
        t = written(_per_block(slim, on, names, rule.transfer), "transfers")
        place = _over_blocks(t.select(*on), keys, o.rows).running(_n=("count", F.lit(1))).df.withColumnRenamed(G, B).withColumn("_n", F.col("_n") - 1)
        t = written(t.join(place, on), "transfers")
        entry, rounds = _entries(t.drop(B), keys, rule, fan)
        entry = written(t.select(*on, "_n").join(entry, [*keys, "_n"]).select(*on, "_entry"), "entries")
        src = src.join(entry, on, "left").withColumn("_entry", F.coalesce("_entry", F.lit(float("nan"))))
    else:
        src = src.withColumn("_entry", F.lit(float("nan")))
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)
    kinds = {pa.bool_(): "boolean", pa.float64(): "double", pa.int64(): "long"}
    made = ", ".join(f"{c} {kinds[t]}" for c, t in rule.outputs.items())

    def emit(batches):
        for table, starts in _blocks(batches, on):
            cols, stops = _numbers(table, [*rule.inputs, "_entry"]), np.append(starts[1:], table.num_rows)
            got = [rule.emit({c: v[a:b] for c, v in cols.items()}, cols["_entry"][a]) for a, b in zip(starts, stops)]
            for c, kind in rule.outputs.items():
                table = table.append_column(c, pa.array(np.concatenate([g[c] for g in got]), kind))
            yield from table.combine_chunks().to_batches()

    rows = _spread(src, on, G).mapInArrow(emit, f"{base}, {made}")
    rows = rows.drop(B, "_entry", "_was") if isinstance(rule, Turned) else rows.drop(B, "_entry")
    return Ordered(rows, o.keys, o.rows), rounds

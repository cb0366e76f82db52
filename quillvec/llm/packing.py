"""Problem 6: texts into containers of fixed capacity, by the configuration linear program.

Only the histogram of lengths, which has at most as many entries as the capacity,
reaches the driver. There the program (fewest containers, each filled by some
configuration of lengths, all texts covered) is solved approximately by
multiplicative weights: a knapsack dynamic program finds the configuration of
the greatest summed weight, it is used a little, and the weights of the lengths
it covers fall, until the uses come close to the bound that the weights prove.
The uses are scaled so that no length is used up twice and rounded down; best
fit by decreasing length places the rest, with whole groups of equal containers
at a time. Where best fit alone needs fewer containers, its plan is kept. The
texts themselves are placed in parallel: each task numbers its texts of a length
as it reads them, and sums over tasks turn those numbers into ranks.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillvec.plans.lineage import cut

#: Most rounds of multiplicative weights, how fast weights fall, and the gap between uses and bound at which the rounds end.
ROUNDS = 160
LEARNING_RATE = 4.0
GAP = 0.01
#: Share of the uses that a configuration can have in one round.
STEP = 0.25
#: Units of a capacity in the knapsack program. Lengths are rounded up to them there, so that its work doesn't grow with the square of the capacity.
UNITS = 512
#: Rows of the table of capacities, each of which is planned on the driver.
MAX_SIZES = 1_000


def token_count(text: Column) -> Column:
    """Maximal runs of letters and digits plus other single characters that aren't white space; 0 for null."""
    runs = F.regexp_replace(text, r"[\p{L}\p{N}]+", "x")
    return F.coalesce(F.length(F.regexp_replace(runs, r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+", "")), F.lit(0)).cast("bigint")


def _best_configuration(units: np.ndarray, counts: np.ndarray, weights: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each kind fill one container with the greatest weight (bounded knapsack, by binary splitting of the counts); kinds are in ascending order of units."""
    big = np.flatnonzero(2 * units > capacity)  # of these only one fits: the heaviest up to each room
    alone = np.full(capacity + 1, -1, np.int64)
    value = np.zeros(capacity + 1)
    if len(big):
        value[units[big]] = weights[big]
        alone[units[big]] = big
        value, heaviest = np.maximum.accumulate(value), np.maximum.accumulate(np.where(value >= np.maximum.accumulate(value), np.arange(capacity + 1), 0))
        alone = alone[heaviest]
    taken: list[tuple[int, int, np.ndarray]] = []
    for i in np.flatnonzero(2 * units <= capacity)[::-1].tolist():
        size_of_one, copies = int(units[i]), 1
        left = min(int(counts[i]), capacity // size_of_one)
        while left > 0:
            k = min(copies, left)
            size = k * size_of_one
            with_it = value[: capacity + 1 - size] + k * weights[i]
            better = with_it > value[size:] + 1e-15
            np.copyto(value[size:], with_it, where=better)
            taken.append((i, k, better))
            left -= k
            copies *= 2
    use = np.zeros(len(units), np.int64)
    room = capacity
    for i, k, better in reversed(taken):
        size = k * int(units[i])
        if room >= size and better[room - size]:
            use[i] += k
            room -= size
    if alone[room] >= 0:
        use[alone[room]] += 1
    return use


class Plan:
    """Groups of equal containers and what they hold."""

    def __init__(self, capacity: int):
        self.capacity, self.containers = capacity, 0
        #: length, texts, first container, texts of this length for each container
        self.slots: list[tuple[int, int, int, int]] = []
        self.open: list[tuple[int, int, int]] = []  # room left, first container, containers

    def new(self, n: int) -> int:
        start, self.containers = self.containers, self.containers + n
        return start

    def keep(self, room: int, start: int, n: int) -> None:
        if room and n:
            bisect.insort(self.open, (room, start, n))

    def spread(self, lengths: list[list[int]], start: int, n: int, each: int) -> None:
        """`each` texts into each of `n` containers, taken from the end of `lengths` ([length, texts left] pairs that hold enough)."""
        done, wanted = 0, n * each
        while done < wanted:
            length, left = lengths[-1]
            into = done % each
            take = min(left, wanted - done, each - into if into or left < each else (left // each) * each)
            self.slots.append((length, take, start + done // each, each if take >= each else take))
            done += take
            lengths[-1][1] -= take
            if not lengths[-1][1]:
                lengths.pop()

    def keep_rest(self, slots: int, start: int, n: int) -> None:
        """What room the slots from number `slots` on leave in the `n` containers that they fill."""
        change = {start: 0, start + n: 0}
        for length, count, first, each in self.slots[slots:]:
            for at, by in ((first, each * length), (first + count // each, -each * length)):
                change[at] = change.get(at, 0) + by
        held, points = 0, sorted(change)
        for at, end in zip(points, points[1:]):
            held += change[at]
            self.keep(self.capacity - held, at, end - at)

    def put(self, length: int, room: int, start: int, n: int, left: int) -> int:
        """Fill a group of `n` containers with up to `left` texts; how many went in."""
        each = room // length
        whole, rest = min(n, left // each), 0
        if whole:
            self.slots.append((length, whole * each, start, each))
            self.keep(room - each * length, start, whole)
        if whole < n:
            rest = min(each, left - whole * each)
            if rest:
                self.slots.append((length, rest, start + whole, rest))
                self.keep(room - rest * length, start + whole, 1)
            used = whole + bool(rest)
            self.keep(room, start + used, n - used)
        return whole * each + rest

    def best_fit(self, length: int, left: int) -> None:
        while left > 0:
            at = bisect.bisect_left(self.open, (length,))
            if at < len(self.open):
                room, start, n = self.open.pop(at)
            else:
                room, n = self.capacity, -(-left // (self.capacity // length))
                start = self.new(n)
            left -= self.put(length, room, start, n, left)

    def finish(self, lengths: list[tuple[int, int]]) -> Plan:
        """Best fit of what is left, the longest first."""
        for length, n in sorted(lengths, reverse=True):
            self.best_fit(length, n)
        return self


@dataclass
class Fractions:
    """Configurations (rows: how many of each kind), how often each is used, and the bound that the weights prove."""

    uses: np.ndarray
    times: np.ndarray
    bound: float


def solve_program(units: np.ndarray, counts: np.ndarray, capacity: int) -> Fractions:
    """Uses of configurations by multiplicative weights; a kind is what has one number of units.

    For any weights, the summed weight of all texts over that of the best
    configuration is a lower bound of the program (its dual), and the uses over
    the least covered kind's cover are a solution.
    """
    total, covered, bound = counts.astype(float), np.zeros(len(units)), 0.0
    uses: dict[bytes, float] = {}
    for _ in range(ROUNDS):
        lag = covered / total
        weights = np.exp(-LEARNING_RATE * (lag - lag.min())) * units / capacity
        use = _best_configuration(units, counts, weights, capacity)
        bound = max(bound, float(total @ weights / (use @ weights)))
        some = use > 0
        step = max(1.0, STEP * float((total[some] / use[some]).min()))
        uses[use.tobytes()] = uses.get(use.tobytes(), 0.0) + step
        covered += step * use
        least = float((covered / total).min())
        if least >= 1 and sum(uses.values()) / least <= (1 + GAP) * bound:
            break
    keys = sorted(uses, key=lambda k: (-uses[k], k))
    return Fractions(np.array([np.frombuffer(k, np.int64) for k in keys]), np.array([uses[k] for k in keys]), bound)


def _rounded(histogram: dict[int, int], kinds: list[list[int]], large: list[int], capacity: int, program: Fractions, times: np.ndarray) -> Plan:
    """The plan of the uses rounded down. A configuration whose texts run out is used as often as they last."""
    plan = Plan(capacity)
    stock = [[[length, histogram[length]] for length in of_kind] for of_kind in kinds]
    left = np.array([sum(histogram[length] for length in of_kind) for of_kind in kinds], np.int64)
    for use, x in zip(program.uses, times, strict=True):
        some = use > 0
        n = min(int(x + 1e-9), int((left[some] // use[some]).min()))
        if n > 0:
            start, slots = plan.new(n), len(plan.slots)
            for i in np.flatnonzero(some).tolist():
                plan.spread(stock[i], start, n, int(use[i]))
            left = left - n * use
            plan.keep_rest(slots, start, n)
    return plan.finish([(length, n) for of_kind in stock for length, n in of_kind] + [(length, histogram[length]) for length in large])


def plan_containers(histogram: dict[int, int], capacity: int) -> Plan:
    """Containers for `histogram` (length from 1 to the capacity: texts of it); never more than best fit by decreasing length alone needs."""
    if not histogram:
        return Plan(capacity)
    unit = -(-capacity // UNITS)
    by_unit: dict[int, list[int]] = {}
    for length in sorted(histogram):
        by_unit.setdefault(-(-length // unit), []).append(length)
    whole = capacity // unit  # a text of more than these units fills a container by itself
    large = [length for u in by_unit if u > whole for length in by_unit[u]]
    units = np.array(sorted(u for u in by_unit if u <= whole), np.int64)
    plans = [Plan(capacity).finish(list(histogram.items()))]
    if len(units):
        kinds = [by_unit[int(u)] for u in units]
        counts = np.array([sum(histogram[length] for length in of_kind) for of_kind in kinds], np.int64)
        program = solve_program(units, counts, whole)
        cover = program.times @ program.uses / counts
        # uses that take no length twice, and uses that cover every length
        for over in dict.fromkeys((float(cover.max()), max(float(cover.min()), 1.0))):
            plans.append(_rounded(histogram, kinds, large, capacity, program, program.times / over))
    return min(reversed(plans), key=lambda p: p.containers)


class Slots:
    """A plan's slots in the order of lengths, to be searched by length and rank."""

    def __init__(self, plan: Plan):
        slots = sorted(plan.slots, key=lambda s: s[0])  # within a length in the order of the plan
        length, n, self.start, self.each = (np.array(x, np.int64) for x in zip(*slots, strict=True))
        self.at = np.cumsum(n) - n
        first = np.flatnonzero(np.r_[True, length[1:] != length[:-1]])
        self.lengths, self.base = length[first], self.at[first]

    def containers(self, tokens: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = self.base[np.searchsorted(self.lengths, tokens)] + rank
        slot = np.searchsorted(self.at, at, "right") - 1
        return self.start[slot] + (at - self.at[slot]) // self.each[slot]


def pack_texts(texts: DataFrame, sizes: DataFrame, id_col: str = "doc_id", tokens: str | Column = "tokens") -> DataFrame:
    """`size_id, capacity, doc_id, piece INT, tokens BIGINT, container BIGINT`: the container of every text or piece.

    `sizes` has `size_id` and `capacity` (at most MAX_SIZES distinct rows, as
    each capacity is planned on the driver); rows whose capacity is null or under
    1 are ignored, and a null size_id is a size like any other. Only a text
    longer than the capacity is cut, into pieces of exactly the capacity, from 0,
    and one for the rest. A text of no (or null) tokens takes no room and lies in
    container 0. Every row is packed, repeated ones too; a null id is packed like
    any other. Which of the texts of one length goes where follows from the order
    in which they are read. Without texts there are no rows. Columns of other
    names are ignored.
    """
    spark = texts.sparkSession
    size = F.col(tokens) if isinstance(tokens, str) else tokens
    wanted = sizes.select("size_id", F.col("capacity").cast("bigint").alias("capacity")).where("capacity >= 1").distinct()
    held = wanted.limit(MAX_SIZES + 1).collect()
    if len(held) > MAX_SIZES:
        raise ValueError(f"more than {MAX_SIZES} capacities")
    held.sort(key=lambda r: (r.capacity, r.size_id is not None, r.size_id))
    capacities = [r.capacity for r in held]
    rows = texts.select(F.col(id_col).alias("doc_id"), F.coalesce(size, F.lit(0)).cast("bigint").alias("n"))
    id_type, size_type = rows.schema["doc_id"].dataType.simpleString(), wanted.schema["size_id"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces, and of each its number among those of its size and length in this task."""
        part, seen = TaskContext.get().partitionId(), [{} for _ in capacities]
        for whole in batches:
            for s in range(0, whole.num_rows, 10_000):
                batch = whole.slice(s, 10_000)
                n = batch.column(1).to_numpy(zero_copy_only=False)
                for c, capacity in enumerate(capacities):
                    pieces = np.maximum(1, -(-n // capacity))
                    row = np.repeat(np.arange(len(n)), pieces)
                    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    length = np.minimum(capacity, n[row] - piece * capacity)
                    order = np.argsort(length, kind="stable")
                    value, first, count = np.unique(length[order], return_index=True, return_counts=True)
                    before = np.array([seen[c].get(v, 0) for v in value.tolist()], np.int64)
                    local = np.empty(len(row), np.int64)
                    local[order] = np.arange(len(row)) - np.repeat(first - before, count)
                    seen[c].update(zip(value.tolist(), (before + count).tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), c), pa.int32()), batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(length), pa.array(np.full(len(row), part), pa.int32()), pa.array(local)], names=["c", "doc_id", "piece", "tokens", "part", "local"])

    # written once: both uses below have to see the same numbers
    pieces = cut(rows.mapInArrow(number, f"c int, doc_id {id_type}, piece int, tokens bigint, part int, local bigint"), "pieces")
    counts = cut(pieces.groupBy("c", "tokens", "part").agg(F.count("*").alias("n")), "lengths")
    histograms: dict[int, dict[int, int]] = {}
    for r in counts.where("tokens > 0").groupBy("c", "tokens").agg(F.sum("n").alias("n")).collect():
        histograms.setdefault(r.c, {})[r.tokens] = r.n
    shared = spark.sparkContext.broadcast({c: Slots(plan_containers(histogram, capacities[c])) for c, histogram in histograms.items()})
    before = F.sum("n").over(Window.partitionBy("c", "tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("c", "tokens", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    ranked = pieces.join(offsets, ["c", "tokens", "part"]).select("c", "doc_id", "piece", "tokens", (F.col("offset") + F.col("local")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 3, 4))
            container = np.zeros(len(c), np.int64)
            for x in np.unique(c).tolist():
                mine = np.flatnonzero((c == x) & (length > 0))
                if len(mine):
                    container[mine] = shared.value[x].containers(length[mine], rank[mine])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(container)], names=["c", "doc_id", "piece", "tokens", "container"])

    placed = ranked.mapInArrow(place, f"c int, doc_id {id_type}, piece int, tokens bigint, container bigint")
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("c") + 1) if held else F.lit(None).cast(kind)
    return placed.select(of([r.size_id for r in held], size_type).alias("size_id"), of(capacities, "bigint").alias("capacity"), "doc_id", "piece", "tokens", "container")

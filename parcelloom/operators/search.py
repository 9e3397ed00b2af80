"""Plan search by local moves: chains are sequential, so each runs in one task and many run side by side.

A chain works on plain lists over a compact copy of the map that its task reads from the shared folder.  It keeps, for every
district, totals, perimeter and frontier up to date move by move; ``Chain.check`` recomputes them, which is what the
tests compare.  All randomness comes from ``[seed, chain]``.
"""

from __future__ import annotations

import math
import random
from array import array
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelloom.functions.metrics import Metric, Objective
from parcelloom.storage import batches_in_order, shared_folder

#: Directed edges of a map that chains may hold; the largest state has about 4 million.
MAX_EDGES = 50_000_000


class Near(Sequence):
    """For each unit its neighbours with boundary lengths, from arrays over all edges by unit."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> None:
        self.starts, self.ends, self.lengths = memoryview(starts), memoryview(ends), memoryview(lengths)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, u: int) -> list[tuple[int, float]]:
        a, b = self.starts[u], self.starts[u + 1]
        return list(zip(self.ends[a:b].tolist(), self.lengths[a:b].tolist()))


class Graph:
    """A map's units: neighbours with boundary lengths (``near``), outer boundary and series.

    It is in two sorted tables of the shared folder; what is sent around is where they are.  A task that runs a chain, or a
    driver that asks, reads them into arrays of some 100 bytes a unit.
    """

    def __init__(self, folder: str, units: int, edges: int, names: list[str]) -> None:
        self.folder, self.units, self.edges, self.names = folder, units, edges, names

    @staticmethod
    def collect(units: DataFrame, edges: DataFrame, outer: DataFrame, series: list[str]) -> "Graph":
        """From tables of one map, whose size is checked first."""
        folder = shared_folder(units.sparkSession)
        edges.select("src", "dst", F.col("w").cast("double")).repartitionByRange("src").sortWithinPartitions("src", "dst").write.parquet(f"{folder}/edges")
        if (m := units.sparkSession.read.parquet(f"{folder}/edges").count()) > MAX_EDGES:
            raise ValueError(f"{m} edges are too many for a chain")
        rows = units.drop("outer_perimeter_m").join(outer, "idx", "left").na.fill(0.0, ["outer_perimeter_m"])
        rows.select("idx", *(F.col(c).cast("double") for c in ("outer_perimeter_m", *series))).repartitionByRange("idx").sortWithinPartitions("idx").write.parquet(f"{folder}/units")
        n, low, high, different = units.sparkSession.read.parquet(f"{folder}/units").agg(F.count("*"), F.min("idx"), F.max("idx"), F.count_distinct("idx")).first()
        if n and (low, high, different) != (0, n - 1, n):
            raise ValueError("units must be numbered from 0 without gaps")
        return Graph(folder, n, m, list(series))

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("folder", "units", "edges", "names")}

    def __getattr__(self, name: str):
        if name not in ("near", "outer", "series"):
            raise AttributeError(name)
        self._read()
        return self.__dict__[name]

    def _read(self) -> None:
        starts, ends, lengths = np.zeros(self.units + 1, np.int64), np.empty(self.edges, np.int32), np.empty(self.edges)
        at = 0
        for batch in batches_in_order(f"{self.folder}/edges"):
            src = batch.column("src").to_numpy()
            counts = np.bincount(src - src[0])  # rows are sorted
            starts[1 + src[0] : 1 + src[0] + len(counts)] += counts
            ends[at : at + len(src)] = batch.column("dst").to_numpy()
            lengths[at : at + len(src)] = batch.column("w").to_numpy()
            at += len(src)
        columns = {c: np.empty(self.units) for c in ("outer_perimeter_m", *self.names)}
        at = 0
        for batch in batches_in_order(f"{self.folder}/units"):
            for c, values in columns.items():
                if batch.column(c).null_count:
                    raise ValueError(f"{c} has nulls")
                values[at : at + len(batch)] = batch.column(c).to_numpy()
            at += len(batch)
        self.near = Near(np.cumsum(starts), ends, lengths)
        self.outer = memoryview(columns["outer_perimeter_m"])
        self.series = {c: memoryview(columns[c]) for c in self.names}


class Chain:
    """A plan of districts 1 to ``n`` (0 is unassigned) and everything that moves need."""

    def __init__(self, graph: Graph, n: int, rng: random.Random, districts: list[int] | None = None) -> None:
        self.g, self.n, self.rng = graph, n, rng
        self.rebuild(districts or [0] * len(graph.near))

    def rebuild(self, districts: list[int]) -> None:
        self.of = list(districts)
        self.size, self.total, self.perimeter = self.check()
        self.frontier: list[list[int]] = [[] for _ in range(self.n + 1)]
        self.place = [-1] * len(self.of)
        self.cross = [sum(self.of[v] != d for v, _ in self.g.near[u]) for u, d in enumerate(self.of)]
        for u, c in enumerate(self.cross):
            if c:
                self._enter(u, self.of[u])

    def check(self) -> tuple[list[int], dict[str, list[float]], list[float]]:
        """Sizes, totals and perimeters of all districts, from nothing but the assignment."""
        size, total, perimeter = [0] * (self.n + 1), {s: [0.0] * (self.n + 1) for s in self.g.series}, [0.0] * (self.n + 1)
        for u, d in enumerate(self.of):
            size[d] += 1
            for s, values in self.g.series.items():
                total[s][d] += values[u]
            perimeter[d] += self.g.outer[u] + sum(w for v, w in self.g.near[u] if self.of[v] != d)
        return size, total, perimeter

    def _enter(self, u: int, d: int) -> None:
        self.place[u] = len(self.frontier[d])
        self.frontier[d].append(u)

    def _leave(self, u: int, d: int) -> None:
        members, i = self.frontier[d], self.place[u]
        last = members.pop()
        if last != u:
            members[i] = last
            self.place[last] = i
        self.place[u] = -1

    def move(self, units: list[int], to: int) -> None:
        """Units into another district, one after another."""
        near, of, cross = self.g.near, self.of, self.cross
        for u in units:
            d = of[u]
            if d == to:
                continue
            self.size[d] -= 1
            self.size[to] += 1
            for s, values in self.g.series.items():
                self.total[s][d] -= values[u]
                self.total[s][to] += values[u]
            self.perimeter[d] -= self.g.outer[u]
            self.perimeter[to] += self.g.outer[u]
            if cross[u]:
                self._leave(u, d)
            of[u] = to
            for v, w in near[u]:
                e = of[v]
                if e == d:
                    self.perimeter[d] += w
                    self.perimeter[to] += w
                    cross[u] += 1
                    cross[v] += 1
                    if cross[v] == 1:
                        self._enter(v, e)
                elif e == to:
                    self.perimeter[d] -= w
                    self.perimeter[to] -= w
                    cross[u] -= 1
                    cross[v] -= 1
                    if cross[v] == 0:
                        self._leave(v, e)
                else:
                    self.perimeter[d] -= w
                    self.perimeter[to] += w
            if cross[u]:
                self._enter(u, to)

    # ---- contiguity ----

    def pieces_without(self, u: int) -> list[list[int]]:
        """What taking a unit out of its district cuts off: all components of the rest but the largest."""
        d, of, near = self.of[u], self.of, self.g.near
        ends = [v for v, _ in near[u] if of[v] == d]
        if len(ends) < 2:
            return []
        seen, pieces = {u}, []
        for start in ends:
            if start in seen:
                continue
            seen.add(start)
            piece, queue, waiting = [start], deque([start]), {v for v in ends if v not in seen}
            while queue:
                if not waiting and not pieces:
                    return []  # all neighbours hang together: nothing is cut off
                for v, _ in near[queue.popleft()]:
                    if v not in seen and of[v] == d:
                        seen.add(v)
                        waiting.discard(v)
                        piece.append(v)
                        queue.append(v)
            pieces.append(piece)
        pieces.sort(key=len)
        return pieces[:-1]

    def allowed(self, units: list[int], to: int) -> bool:
        """Whether a connected set may move: it touches its goal (unless that is empty or 0) and leaves its district in one piece."""
        inside, of, near = set(units), self.of, self.g.near
        d = of[units[0]]
        if to and self.size[to] and not any(of[v] == to for u in units for v, _ in near[u]):
            return False
        ends = {v for u in units for v, _ in near[u] if of[v] == d and v not in inside}
        if len(ends) < 2:
            return True
        start = next(iter(ends))
        seen, queue, left = {start}, deque([start]), len(ends) - 1
        while queue and left:
            for v, _ in near[queue.popleft()]:
                if v not in seen and v not in inside and of[v] == d:
                    seen.add(v)
                    left -= v in ends
                    queue.append(v)
        return left == 0

    def components(self, d: int) -> list[list[int]]:
        left, out = {u for u, e in enumerate(self.of) if e == d}, []
        while left:
            start = left.pop()
            piece, queue = [start], deque([start])
            while queue:
                for v, _ in self.g.near[queue.popleft()]:
                    if v in left:
                        left.discard(v)
                        piece.append(v)
                        queue.append(v)
            out.append(piece)
        return out

    def contiguous(self) -> bool:
        return all(len(self.components(d)) <= 1 for d in range(1, self.n + 1))

    def with_articulation(self, u: int, to: int) -> bool:
        """Move a unit that touches ``to`` with all that it would cut off; False if it doesn't touch."""
        if not any(self.of[v] == to for v, _ in self.g.near[u]) and self.size[to]:
            return False
        self.move([u, *(x for piece in self.pieces_without(u) for x in piece)], to)
        return True

    # ---- random choices ----

    def random_neighbour(self, u: int, skip_zero: bool = True) -> int | None:
        """The district across a random edge of a unit that leads out of its own, each edge alike."""
        out = [self.of[v] for v, _ in self.g.near[u] if self.of[v] != self.of[u] and (self.of[v] or not skip_zero)]
        return self.rng.choice(out) if out else None

    def propose(self) -> tuple[list[int], int] | None:
        """A frontier unit of a district drawn by frontier size, with what it cuts off, and where it goes."""
        weights = [max(len(f) - 1, 0) for f in self.frontier[1:]]
        if not any(weights):
            return None
        d = self.rng.choices(range(1, self.n + 1), weights)[0]
        u = self.rng.choice(self.frontier[d])
        to = self.random_neighbour(u)
        if to is None:
            return None
        units = [u, *(x for piece in self.pieces_without(u) for x in piece)]
        return (units, to) if len(units) < self.size[d] else None

    # ---- plans ----

    def randomize(self) -> None:
        """Districts grown from random seeds, a random unassigned neighbour at a time; what no seed reaches stays 0."""
        self.rebuild([0] * len(self.of))
        for d, u in enumerate(self.rng.sample(range(len(self.of)), min(self.n, len(self.of))), 1):
            self.move([u], d)
        while True:
            edge = [u for u in self.frontier[0]]
            if not edge:
                return
            self.rng.shuffle(edge)
            for u in edge:
                if self.of[u] == 0 and (to := self.random_neighbour(u)):
                    self.move([u], to)

    def equalize_pair(self, series: str, a: int, b: int, tolerance: float, steps: int = 10_000) -> None:
        """Move random boundary units from the heavier of two districts until half the difference has gone; back again if too much has."""
        values = self.g.series[series]
        for _ in range(40):
            src, to = (a, b) if self.total[series][a] >= self.total[series][b] else (b, a)
            left = (self.total[series][src] - self.total[series][to]) / 2
            while left > 0 and steps:
                steps -= 1
                if len(self.frontier[src]) < 1 or self.size[src] < 2:
                    return
                u = self.rng.choice(self.frontier[src])
                if not any(self.of[v] == to for v, _ in self.g.near[u]):
                    continue
                units = [u, *(x for piece in self.pieces_without(u) for x in piece)]
                if len(units) >= self.size[src]:
                    continue
                self.move(units, to)
                left -= sum(values[x] for x in units)
            if -left <= tolerance or not steps:
                return
            tolerance *= 1.2

    def equalize_step(self, series: str, tolerance: float) -> bool:
        """One round; True once all districts are within ``tolerance`` of the mean."""
        w = self.total[series]
        target = sum(w[1:]) / self.n
        far = [abs(x - target) for x in w[1:]]
        if max(far) <= target * tolerance:
            return True
        if max(far) > 2 * target and self.n > 2:
            least = min(range(1, self.n + 1), key=lambda d: w[d])
            beside = {self.of[v] for u in self.frontier[least] for v, _ in self.g.near[u]} - {0, least}
            if beside:
                self.move([u for u, d in enumerate(self.of) if d == least], min(beside, key=lambda d: w[d]))
                heavy = max(range(1, self.n + 1), key=lambda d: w[d])
                self.with_articulation(self.rng.choice([u for u, d in enumerate(self.of) if d == heavy]), least)
                return False
        d = self.rng.choices(range(1, self.n + 1), far)[0]
        if not self.frontier[d]:
            return False
        other = self.random_neighbour(self.rng.choice(self.frontier[d]))
        if other:
            self.equalize_pair(series, d, other, max(far) / 2)
        return False

    def equalize(self, series: str, tolerance: float, max_iter: int) -> bool:
        return any(self.equalize_step(series, tolerance) for _ in range(max_iter))

    def balance_cost(self, series: str, boundary: float) -> float:
        target = sum(self.total[series][1:]) / self.n
        return sum((x - target) ** 2 / target for x in self.total[series][1:]) * (1 - boundary) + (sum(self.perimeter[1:]) - sum(self.g.outer)) / 2 * boundary

    def _cut_change(self, units: list[int], to: int) -> float:
        """How much longer the cut gets, from the edges of all the units that move."""
        inside, d = set(units), self.of[units[0]]
        return sum(w if self.of[v] == d else -w if self.of[v] == to else 0.0 for u in units for v, w in self.g.near[u] if v not in inside)

    def anneal_balance(self, series: str, iterations: int, hot: float, cold: float, boundary: float) -> None:
        """Metropolis moves that even out a series and shorten the cut, while the temperature falls geometrically."""
        values = self.g.series[series]
        target = sum(self.total[series][1:]) / self.n
        for i in range(iterations):
            if not (got := self.propose()):
                continue
            units, to = got
            w = sum(values[u] for u in units)
            here, there = self.total[series][self.of[units[0]]], self.total[series][to]
            cost = 2 * w * (w + there - here) / target * (1 - boundary) + self._cut_change(units, to) * boundary
            if cost < 0 or self.rng.random() < math.exp(-cost / (hot * (cold / hot) ** (i / iterations))):
                self.move(units, to)

    def tabu_balance(self, series: str, iterations: int, tenure: int, boundary: float, candidates: int) -> None:
        """The best of some random moves each time, none that is tabu unless it beats the best cost; the best plan stays."""
        values = self.g.series[series]
        target = sum(self.total[series][1:]) / self.n
        cost = best = self.balance_cost(series, boundary)
        kept, tabu = list(self.of), {}
        for i in range(iterations):
            choice = None
            for _ in range(candidates):
                if not (got := self.propose()):
                    continue
                units, to = got
                w, d = sum(values[u] for u in units), self.of[units[0]]
                change = 2 * w * (w + self.total[series][to] - self.total[series][d]) / target * (1 - boundary) + self._cut_change(units, to) * boundary
                if tabu.get((units[0], to), -1) >= i and cost + change >= best - 1e-9:
                    continue
                if choice is None or change < choice[0]:
                    choice = (change, units, to, d)
            if choice is None:
                continue
            change, units, to, d = choice
            self.move(units, to)
            tabu[units[0], d] = i + tenure
            cost += change
            if cost < best:
                best, kept = cost, list(self.of)
        self.rebuild(kept)

    # ---- recombination ----

    def spanning_tree(self, units: Sequence[int]) -> tuple[Sequence[int], Sequence[int]]:
        """A uniform random spanning tree of a connected set: units with parents before children, and each one's parent's place."""
        n, rng, near = len(units), self.rng, self.g.near
        # units by their places in the set from here on
        place = {u: i for i, u in enumerate(units)} if n * 8 < len(near) else None
        if place is None:
            numbers = np.full(len(near), -1, np.int32)
            numbers[np.asarray(units)] = np.arange(n, dtype=np.int32)
            place = memoryview(numbers)
            inside = lambda v: place[v] >= 0
        else:
            inside = place.__contains__
        first, ends = array("q", [0]), array("i")
        for u in units:
            ends.extend(place[v] for v, _ in near[u] if inside(v))
            first.append(len(ends))
        del place
        root = rng.choice(range(n))
        parent, step = array("i", [-1]) * n, array("i", [-1]) * n
        parent[root] = root
        joined = array("i")
        for u in range(n):
            v = u
            while parent[v] < 0:  # a loop is forgotten when its steps are written over
                step[v] = rng.choice(ends[first[v] : first[v + 1]])
                v = step[v]
            v = u
            while parent[v] < 0:
                parent[v] = step[v]
                joined.append(v)
                v = step[v]
        # children of each, in the order in which they joined
        above = np.asarray(parent)[np.asarray(joined, dtype=np.int32)]
        children = array("i", np.asarray(joined, dtype=np.int32)[np.argsort(above, kind="stable")].tobytes())
        at = array("q", np.concatenate([[0], np.cumsum(np.bincount(above, minlength=n))]).astype(np.int64).tobytes())
        order, back = array("i", [root]), array("i", [0])
        for i, u in enumerate(order):
            found = children[at[u] : at[u + 1]]
            order.extend(found)
            back.extend([i] * len(found))
        return array("i", (units[u] for u in order)), back

    def balanced_cut(self, order: Sequence[int], parent: Sequence[int], values: Sequence[float]) -> list[int]:
        """The subtree whose weight is nearest to half of all."""
        below = array("d", (values[u] for u in order))
        for i in range(len(order) - 1, 0, -1):
            below[parent[i]] += below[i]
        top = min(range(1, len(order)), key=lambda i: abs(below[i] - below[0] / 2))
        chosen = bytearray(len(order))
        chosen[top] = True
        for i in range(top + 1, len(order)):
            chosen[i] = chosen[parent[i]]
        return [u for u, c in zip(order, chosen) if c]

    def recombine(self, a: int, b: int, series: str) -> bool:
        """Two bordering districts redrawn along a random spanning tree of both; False if they don't border."""
        units = array("i", (u for u, d in enumerate(self.of) if d in (a, b)))
        if not any(self.of[u] == a and self.of[v] == b for u in units for v, _ in self.g.near[u]):
            return False
        order, parent = self.spanning_tree(units)
        if len(order) < max(2, len(units)):
            return False
        part = bytearray(len(self.of))
        for u in self.balanced_cut(order, parent, self.g.series[series]):
            part[u] = True
        for u in units:
            self.move([u], b if part[u] else a)
        return True

    def recombine_some(self, steps: int, series: str) -> None:
        for _ in range(steps):
            d = self.rng.randint(1, self.n)
            if self.frontier[d] and (other := self.random_neighbour(self.rng.choice(self.frontier[d]))):
                self.recombine(d, other, series)


def _metric(m: Metric, chain: Chain, d: int, region: dict[str, float]) -> float:
    """A district's value of a metric, as the column expressions have it."""
    s = [chain.total[x][d] for x in m.series]
    if m.kind.startswith("population"):
        far = s[0] / (region[m.series[0]] / chain.n) - 1
        if m.kind == "population_deviation":
            return far
        if m.kind == "population_deviation_absolute":
            return abs(far)
        if m.kind == "population_deviation_sharp":
            return min(1 - abs(far), 1.0)
        limit = 1.0 if far <= 0 else chain.n - 1.0
        return (1 - far * far / (limit * limit)) / (1 + far * far) if limit else math.nan
    if m.kind.startswith("compactness"):
        p = chain.perimeter[d]
        if p <= 1e-6:
            return math.inf
        return 4 * math.pi * s[0] / (p * p) if m.kind.endswith("popper") else 2 * math.pi * math.sqrt(s[0] / math.pi) / p
    lean = (s[0] - s[1]) / (s[0] + s[1]) if s[0] + s[1] else 0.0
    half, t = abs(lean) / 2, m.parameter
    return {
        "partisan_lean": lambda: lean, "competitiveness_binary": lambda: float(half <= t), "competitiveness_gaussian": lambda: math.exp(-half * half / (2 * t * t)),
        "competitiveness_quadratic": lambda: 1 - 2 / t * half * half if half <= t else 2 / (0.5 - t) * (0.5 - half) ** 2,
    }[m.kind]()


class Scorer:
    """An objective's value of a chain; a move changes two districts, so only their metrics are computed again."""

    def __init__(self, objective: Objective, chain: Chain) -> None:
        self.o, self.c = objective, chain
        self.region = {s: sum(v) for s, v in chain.g.series.items()}
        self.values = [[_metric(m, chain, d, self.region) for d in range(1, chain.n + 1)] for m in objective.metrics]

    def update(self, districts: tuple[int, ...]) -> float:
        for row, m in zip(self.values, self.o.metrics):
            for d in districts:
                if d:
                    row[d - 1] = _metric(m, self.c, d, self.region)
        return self.value()

    def value(self) -> float:
        total = sum(self.o.weights)
        return sum(w * sum(row) / len(row) for w, row in zip(self.o.weights, self.values)) / total if total > 0 else 0.0


@dataclass
class Phase:
    """An objective, and how annealing goes for it: cool until moves are accepted at ``end_prob``, or until none has been for a while."""

    objective: Objective
    start_prob: float = 0.5
    end_prob: float | None = None
    cooling_rate: float = 0.05


@dataclass
class AnnealOptions:
    max_iter: int = 10_000
    init_temp: float = 1.0
    batch: int = 100
    tune_batch: int = 50
    early_stop_iters: int = 2_000
    trace: list = field(default_factory=list)


def anneal(chain: Chain, phases: list[Phase], o: AnnealOptions) -> list[tuple]:
    """Annealing phase by phase, maximising each objective; the best plan of the last phase stays.

    Returns the trace: iteration, phase, objective, best, temperature, mean acceptance chance and the last batch's share of moves.
    """
    if chain.size[0] or chain.n < 2:
        raise ValueError("annealing needs a full plan of two districts or more")
    done, temperature, trace = 0, o.init_temp, []
    best, kept, now = -math.inf, list(chain.of), 0.0
    for number, phase in enumerate(phases, 1):
        scorer = Scorer(phase.objective, chain)
        now = best = scorer.value()
        kept = list(chain.of)

        def batch(size: int) -> tuple[float, int]:
            nonlocal done, now, best, kept
            chance, accepted, tried = 0.0, 0, 0
            for _ in range(size):
                if done >= o.max_iter:
                    break
                done += 1
                if not (got := chain.propose()):
                    continue
                units, to = got
                d = chain.of[units[0]]
                chain.move(units, to)
                after = scorer.update((d, to))
                delta = after - now - 1e-10
                p = 1.0 if delta > 0 else math.exp(delta / temperature)
                chance += p
                tried += 1
                if chain.rng.random() < p:
                    now, accepted = after, accepted + 1
                    if now > best:
                        best, kept = now, list(chain.of)
                else:
                    chain.move(units, d)
                    scorer.update((d, to))
            mean = chance / tried if tried else 0.0
            trace.append((done, number, now, best, temperature, mean, accepted / size))
            return mean, accepted

        low, high = temperature * 1e-10, temperature * 1e10
        for _ in range(100):
            mean, _ = batch(o.tune_batch)
            if abs(mean - phase.start_prob) < 0.05 or done >= o.max_iter:
                break
            if mean < phase.start_prob:
                low = math.sqrt(low * temperature)
            else:
                high = math.sqrt(high * temperature)
            temperature = math.sqrt(low * high)
        quiet = 0
        while done < o.max_iter:
            mean, accepted = batch(o.batch)
            quiet = 0 if accepted else quiet + o.batch
            if phase.end_prob is not None and mean <= phase.end_prob or phase.end_prob is None and quiet >= o.early_stop_iters:
                break
            temperature *= 1 - phase.cooling_rate
    if now < best:
        chain.rebuild(kept)
    return trace


_TRACE = "chain int, kind string, idx int, district int, iter long, phase int, obj double, best double, temp double, prob double, curr_prob double"


def ensemble(spark: SparkSession, graph: Graph, n: int, chains: int, seed: int, search, first: list[int] | DataFrame | None = None) -> DataFrame:
    """``search(chain)`` on many chains, a task each; rows of ``kind`` plan (``idx, district``) and trace.

    ``search`` may return trace rows.  Chains start from the districts in ``first``, or each from its own where that is a
    table ``chain, districts`` (then ``chains`` is not used), or else at random.
    """
    own = isinstance(first, DataFrame)
    given = None if own else first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _TRACE.split(", ")]
        types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in _TRACE.split(", ")]
        for batch in batches:
            for k, number in enumerate(batch.column(0).to_pylist()):
                start = batch.column(1)[k].as_py() if own else given
                chain = Chain(graph, n, random.Random(f"{seed}/{number}"), start)
                if start is None:
                    chain.randomize()
                trace = search(chain) or []
                for at in range(0, len(chain.of), 65536):
                    part = chain.of[at : at + 65536]
                    known = [[number] * len(part), ["plan"] * len(part), range(at, at + len(part)), part]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(known, types)), *(pa.nulls(len(part), t) for t in types[4:])], names=names)
                for at in range(0, len(trace), 65536):
                    rows = [(number, "trace", None, None, *t) for t in trace[at : at + 65536]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    if own:
        return first.repartition(max(1, min(first.count(), 65536)), "chain").mapInArrow(run, _TRACE)
    return spark.range(chains).repartition(chains, "id").mapInArrow(run, _TRACE)


def starts(plan: DataFrame, chains: int | None = None) -> DataFrame:
    """``chain, districts`` (by unit) of every chain of a plan; or of ``chains`` chains numbered from 0, which take its chains in turn."""
    each = plan.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "district"))), lambda x: x["district"]).alias("districts"))
    if chains is None:
        return each
    # a row for each chain
    numbers = [r["chain"] for r in plan.select("chain").distinct().orderBy("chain").collect()]
    if not numbers:
        return each
    pairs = plan.sparkSession.createDataFrame([(numbers[k % len(numbers)], k) for k in range(chains)], "chain int, _new int")
    return each.join(pairs, "chain").select(F.col("_new").alias("chain"), "districts")


def plans_of(found: DataFrame) -> DataFrame:
    return found.where("kind = 'plan'").select("chain", "idx", "district")


def trace_of(found: DataFrame) -> DataFrame:
    return found.where("kind = 'trace'").drop("kind", "idx", "district")

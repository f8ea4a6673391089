"""Communities by local moving, refinement and aggregation (Leiden; Louvain without the refinement).

A node takes the community of its neighbours with the greatest gain if that is better than where it is (ties: the least
community, or the one of the least neighbour where nodes move one after another), until no node wants to move. Leiden then parts each community again: from single nodes, those still
alone join the best part of their own community. Communities (Leiden: parts, which begin in their community) become the
nodes of a weighted graph and the next level begins, until a level brings nothing together. The objective is modularity
or, with ``gamma``, the constant Potts model.

Moves are made inside blocks of nodes of bounded size, one task each: over arrays, by batches of nodes that move at once, as
long as that betters the objective; of few nodes and at the end one after another. A graph of one block, as most are after
a level or two, is finished in one task, all levels of it. A larger one is dealt anew to blocks by a hash in each
round: each sees the communities of its nodes' neighbours as they were before the round, and of its nodes those move whose
turn it is, so two neighbours can't swap for ever. When the nodes that want to move fit one block, they and as many
others as have room move there, each seeing the moves before it. So a level ends when no node of the whole graph wants to move, whatever the number of blocks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.graph import components
from lattica.session import drop_written, written

#: Rounds of a level beyond which something is wrong: the operator fails rather than returning what has not settled.
SAFETY = 1000
#: Links (in both directions) of a block: some 400 MB of a worker at most.
BLOCK = 10_000_000
#: Links that one step over arrays works on: so few that they stay in the cache.
STEP = 100_000
#: Batches of a pass: the nodes of one move at once.
BATCHES = 16
#: Times that a pass asks again those due, before the others are looked at.
SWEEPS = 100
#: Up to so many nodes move one after another.
FEW = 1000
#: Gains below are none: what the rounding of sums may pretend.
LEAST_GAIN = 1e-9


class _Block:
    """Nodes 0..n-1 with their links in compressed rows, and the moves over them."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, weight: np.ndarray, per: float):
        key = src.astype(np.int64)
        key <<= 32
        key |= dst
        order = np.argsort(key)
        self.alike = len(w) > 0 and bool((w == w[0]).all())  # then links are counted, not summed
        self.dst, self.w = dst[order].astype(np.int32), np.broadcast_to(w[:1], len(w)) if self.alike else w[order]
        self.n, self.weight, self.per, self.share = n, weight, per, per * weight
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])

    def links(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray | slice]:
        """For each link of the nodes (in rising order), which of them has it; and where these links stand."""
        begin = self.ends[nodes]
        sizes = self.ends[nodes + 1] - begin
        row = np.repeat(np.arange(len(nodes)), sizes)
        if len(nodes) and nodes[-1] - nodes[0] + 1 == len(nodes):
            return row, slice(begin[0], begin[0] + len(row))
        return row, np.arange(len(row)) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)

    def portions(self, nodes: np.ndarray) -> list[np.ndarray]:
        """The nodes in portions of about as many links as one step works on."""
        return np.split(nodes, np.flatnonzero(np.diff(np.cumsum(self.ends[nodes + 1] - self.ends[nodes]) // STEP)) + 1)

    def ask(self, nodes: np.ndarray, comm: np.ndarray, held: np.ndarray, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The community that each of the nodes (in rising order) gains most by, its own if none is better; and what the
        best gain elsewhere lacks to be better (below 0: the node wants to move)."""
        answers = [self._asked(part, comm, held, within) for part in self.portions(nodes)]
        return np.concatenate([to for to, _ in answers]), np.concatenate([lacks for _, lacks in answers])

    def _asked(self, nodes: np.ndarray, comm: np.ndarray, held: np.ndarray, within: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        row, at = self.links(nodes)
        near, w = self.dst[at], None if self.alike else self.w[at]
        if within is not None:
            inner = within[near] == within[nodes][row]
            row, near, w = row[inner], near[inner], None if w is None else w[inner]
        own = comm[nodes]
        to, lacks = own.copy(), np.full(len(nodes), np.inf)
        if not len(row):
            return to, lacks
        key = row << 32 | comm[near]
        if w is None:
            key.sort()
        else:
            order = np.argsort(key)
            key, w = key[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums = np.diff(first, append=len(key)) * self.w[0] if w is None else np.add.reduceat(w, first)
        row, c = key[first] >> 32, key[first] & 0xFFFFFFFF
        mine, total = c == own[row], held[c]
        total[mine] -= self.weight[nodes[row[mine]]]
        gain = sums - self.share[nodes[row]] * total
        least = np.zeros(len(nodes))
        least[row[mine]] = np.maximum(0.0, gain[mine])
        gain[mine] = -np.inf
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        some, top = row[begin], np.full(len(nodes), np.inf)
        highest = np.maximum.reduceat(gain, begin)
        lacks[some] = least[some] + LEAST_GAIN - highest
        top[some] = np.where(lacks[some] < 0, highest, np.inf)
        hit = np.flatnonzero(gain == top[row])[::-1]  # of equals the least community, written last
        to[row[hit]] = c[hit]
        return to, lacks

    def best(self, i: int, comm: list, held: list) -> int:
        """The community that node i gains most by; its own if none is better."""
        at = slice(self.ends[i], self.ends[i + 1])
        sums, own, weight, share = {}, comm[i], float(self.weight[i]), float(self.share[i])
        for j, x in zip(self.dst[at].tolist(), self.w[at].tolist()):
            c = comm[j]
            sums[c] = sums.get(c, 0.0) + x
        least = max(0.0, sums.pop(own) - share * (held[own] - weight)) if own in sums else 0.0
        for c, to in sums.items():
            gain = to - share * held[c]
            if gain > least + LEAST_GAIN:
                own, least = c, gain
        return own

    def settle(self, nodes: np.ndarray, comm: np.ndarray, held: np.ndarray) -> None:
        """Moves the nodes (in rising order) until none of them wants to move; changes ``comm`` and ``held``.

        A pass asks who is due. A node is due again when a neighbour has moved elsewhere, or when what its neighbours'
        communities have lost and its own has gained in the passes since may have made up for what it lacked. When nobody
        who is due moves, all are asked once more. A pass moves by batches as long as that betters the objective, then one
        node after another, which always does.
        """
        mine = np.zeros(self.n, dtype=bool)
        mine[nodes] = True
        due, lacks, rng = mine.copy(), np.zeros(self.n), np.random.default_rng(0)
        in_turn = len(nodes) <= FEW
        while True:
            everyone = bool(due[nodes].all())
            before, lost, won = comm.copy(), np.zeros(len(held)), np.zeros(len(held))
            if in_turn:
                moved = self._in_turn(due, mine, lacks, comm, held, lost, won)
            else:
                moved = self._in_batches(due, mine, lacks, comm, held, lost, won, rng)
            if not moved:
                if everyone:
                    return
                due[nodes] = True
                continue
            in_turn = in_turn or not self._bettered(before, comm, held, won - lost) > 0
            self._lessen(nodes, lacks, comm, lost, won)
            due |= mine & (lacks <= 0)

    def _moved(self, who: np.ndarray, to: np.ndarray, due: np.ndarray, comm: np.ndarray, held: np.ndarray, lost: np.ndarray, won: np.ndarray) -> None:
        own, weight = comm[who], self.weight[who]
        for sums, c, x in ((held, own, -weight), (held, to, weight), (lost, own, weight), (won, to, weight)):
            np.add.at(sums, c, x)
        comm[who] = to
        row, at = self.links(who)
        near = self.dst[at]
        due[near[comm[near] != to[row]]] = True
        due[who] = True

    def _in_batches(self, due, mine, lacks, comm, held, lost, won, rng) -> int:
        """Asks those who are due, and then those whom that makes due; the nodes of a batch move at once."""
        moved = 0
        for _ in range(SWEEPS):
            todo = np.flatnonzero(due)
            if not len(todo):
                break
            for part in np.array_split(rng.permutation(todo), BATCHES):
                part = np.sort(part)
                if not len(part):
                    continue
                due[part] = False
                to, lacks[part] = self.ask(part, comm, held)
                wants = lacks[part] < 0
                if wants.any():
                    moved += int(wants.sum())
                    self._moved(part[wants], to[wants], due, comm, held, lost, won)
            due &= mine
        return moved

    def _in_turn(self, due, mine, lacks, comm, held, lost, won) -> int:
        """Moves those of the nodes due that want to, and their neighbours in turn, one after another."""
        todo = np.flatnonzero(due)
        due[todo] = False
        lacks[todo] = self.ask(todo, comm, held)[1]
        state, totals, moved = comm.tolist(), held.tolist(), 0
        queue = deque(todo[lacks[todo] < 0].tolist())
        waits = bytearray(self.n)
        for i in queue:
            waits[i] = 1
        while queue:
            i = queue.popleft()
            waits[i] = 0
            own, to, weight = state[i], self.best(i, state, totals), float(self.weight[i])
            if to == own:
                continue
            moved += 1
            state[i] = to
            totals[own] -= weight
            totals[to] += weight
            lost[own] += weight
            won[to] += weight
            due[i] = True
            for j in self.dst[self.ends[i] : self.ends[i + 1]].tolist():
                due[j] = True
                if mine[j] and not waits[j] and state[j] != to:
                    waits[j] = 1
                    queue.append(j)
        comm[:], held[:] = state, totals
        due &= mine
        return moved

    def _bettered(self, before: np.ndarray, comm: np.ndarray, held: np.ndarray, change: np.ndarray) -> float:
        """What the objective has gained since ``before`` (twice that); ``change``: of what communities held."""
        who, moved, gained = np.flatnonzero(comm != before), comm != before, 0.0
        for part in self.portions(who):
            row, at = self.links(part)
            near = self.dst[at]
            turned = (comm[near] == comm[part][row]).astype(float) - (before[near] == before[part][row])
            gained += float((self.w[at] * turned * np.where(moved[near], 1, 2)).sum())
        return gained - self.per * float((change * (2 * held - change)).sum())

    def _lessen(self, nodes: np.ndarray, lacks: np.ndarray, comm: np.ndarray, lost: np.ndarray, won: np.ndarray) -> None:
        """Takes from what each node lacks the most that a pass can have changed of it."""
        drop, left = np.zeros(self.n), np.flatnonzero(lost[comm] > 0)
        if len(nodes) == self.n and 4 * (self.ends[left + 1] - self.ends[left]).sum() < len(self.dst):
            for part in self.portions(left):
                row, at = self.links(part)
                np.maximum.at(drop, self.dst[at], lost[comm[part]][row])
        else:
            for part in self.portions(nodes[self.ends[nodes + 1] > self.ends[nodes]]):
                if len(part):
                    begin = np.concatenate([[0], np.cumsum(self.ends[part + 1] - self.ends[part])[:-1]])
                    drop[part] = np.maximum.reduceat(lost[comm[self.dst[self.links(part)[1]]]], begin)
        lacks[nodes] -= self.share[nodes] * (drop[nodes] + won[comm[nodes]])

    def gather(self, nodes: np.ndarray, comm: np.ndarray, held: np.ndarray, members: np.ndarray, within: np.ndarray) -> None:
        """Of the nodes, those that are alone join the best community within their own bounds, until none wants to.

        The nodes of a batch join at once, but not a community whose only node leaves it in the same batch for another,
        unless its number is the greater one: so in each batch one at least of those that want to is no longer alone.
        """
        rng, moved = np.random.default_rng(0), True
        while moved:
            moved = False
            alone = nodes[members[comm[nodes]] == 1]
            for part in np.array_split(rng.permutation(alone), BATCHES if len(alone) > FEW else max(1, len(alone))):
                part = np.sort(part[members[comm[part]] == 1])
                if not len(part):
                    continue
                to, lacks = self.ask(part, comm, held, within)
                wants = lacks < 0
                part, own, to = part[wants], comm[part[wants]], to[wants]
                if not len(part):
                    continue
                moved, leaves = True, np.isin(to, own)
                stays = ~leaves | (own < to)
                part, own, to = part[stays], own[stays], to[stays]
                comm[part] = to
                np.add.at(held, own, -self.weight[part])
                np.add.at(held, to, self.weight[part])
                members[own] -= 1
                np.add.at(members, to, 1)


def _finished(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, weight: np.ndarray, comm: np.ndarray, per: float, refine: bool) -> np.ndarray:
    """The community of each node when all levels from this one on have settled; src, dst, w: each link once."""
    labels = np.arange(n)  # which node of the present graph holds it
    while True:
        block = _Block(n, np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w]), weight, per)
        comm = comm.copy()
        block.settle(np.arange(n), comm, np.bincount(comm, weight, n))
        if len(np.unique(comm)) == n:
            return comm[labels]
        parts = np.arange(n)
        if refine:
            block.gather(np.arange(n), parts, weight.copy(), np.ones(n, dtype=np.int64), comm)
        del block
        if len(np.unique(parts)) == n:  # nothing to put together: the communities themselves go on
            parts = comm
        kept, index = np.unique(parts, return_inverse=True)
        labels, n, weight = index[labels], len(kept), np.bincount(index, weight)
        # a part begins in its community, named by the first of the community's parts
        groups = np.unique(comm[kept] if parts is not comm else kept, return_index=True, return_inverse=True)
        comm = groups[1][groups[2]]
        a, b = index[src], index[dst]
        between = a != b
        key = (np.minimum(a, b) << 32 | np.maximum(a, b))[between]
        del a, b
        pairs, which = np.unique(key, return_inverse=True)
        src, dst, w = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), np.bincount(which, w[between], len(pairs))


def _pieces(n: int, src: np.ndarray, dst: np.ndarray, comm: np.ndarray) -> np.ndarray:
    """The least node of the connected piece of its community that holds each node."""
    inner = comm[src] == comm[dst]
    src, dst, least = src[inner], dst[inner], np.arange(n)
    while True:
        a, b = least[src], least[dst]
        if (a == b).all():
            return least
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least = least[least]


def _dealt(links: DataFrame, nodes: DataFrame, blocks: int, work: Callable, schema: str) -> DataFrame:
    """``work`` over each block. ``links``: block, src, dst, w; ``nodes``: block, node, weight, within, community, held,
    members, mine (of the block), free (may move)."""
    at = F.struct("within", "held", "members", "mine", "free")
    rows = links.select("block", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("x")).withColumn(
        "at", F.lit(None).cast("struct<within:bigint,held:double,members:bigint,mine:boolean,free:boolean>")
    )
    rows = rows.unionByName(nodes.select("block", F.col("node").alias("a"), F.col("community").alias("b"), F.col("weight").alias("x"), at.alias("at")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        edges, states = [], []
        for batch in batches:
            at, cols = batch.column("at"), [batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "x")]
            is_link = at.is_null().to_numpy(zero_copy_only=False)
            edges.append([c[is_link] for c in cols])
            if not is_link.all():
                held = at.filter(at.is_valid())
                states.append([c[~is_link] for c in cols] + [f.to_numpy(zero_copy_only=False) for f in held.flatten()])
        if not states:
            return
        (src, dst, w), (node, community, weight, *rest) = [[np.concatenate(c) for c in zip(*part)] for part in (edges, states)]
        del edges, states
        order = np.argsort(node)
        node, community, weight, *rest = [c[order] for c in (node, community, weight, *rest)]
        src, dst = np.searchsorted(node, src).astype(np.int32), np.searchsorted(node, dst).astype(np.int32)
        out = work(node, src, dst, w, weight, community, *rest)
        for i in range(0, len(out[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in out], names=[c.split(" ")[0] for c in schema.split(", ")])

    return rows.repartitionById(blocks, F.col("block")).drop("block").mapInArrow(run, schema)


def _at_once(edges: DataFrame, state: DataFrame, per: float, refine: bool, split: bool) -> DataFrame:
    """``node, community`` of a graph of one block when all its levels have settled; ``split``: each community parted into
    its connected pieces."""

    def work(node, src, dst, w, weight, community, *_):
        found = _finished(len(node), src, dst, w, weight, np.searchsorted(node, community), per, refine)
        return node, node[_pieces(len(node), src, dst, found) if split else found]

    zero, null = F.lit(0).cast("int").alias("block"), F.lit(None)
    nodes = state.select(
        zero, "node", "weight", "within", "community", null.cast("double").alias("held"), null.cast("long").alias("members"), F.lit(True).alias("mine"), F.lit(True).alias("free")
    )
    return _dealt(edges.where("src < dst").select(zero, "src", "dst", "w"), nodes, 1, work, "node long, community long")


def _settled(edges: DataFrame, start: DataFrame, count: int, per: float, parts: bool, most: int) -> DataFrame:
    """``node, weight, within, community`` when no node wants to move any more. ``start``: the same (``within``: the
    community that a node may not leave; ``parts``: only nodes that are alone move); edges: src, dst, w in both directions,
    ``count`` of them."""

    def work(node, src, dst, w, weight, community, within, held, members, mine, free):
        names, comm = np.unique(community, return_inverse=True)
        first = np.unique(comm, return_index=True)[1]
        block, totals, alone = _Block(len(node), src, dst, w, weight, per), held[first], members[first]
        asked = np.flatnonzero(mine)
        wants = block.ask(asked, comm, totals, within if parts else None)[1] < 0
        turn = np.flatnonzero(mine & free)
        if parts:
            wants &= alone[comm[asked]] == 1
            block.gather(turn, comm, totals, alone, within)
        else:
            block.settle(turn, comm, totals)
        return node[asked], names[comm[asked]], wants

    def round_of(links: DataFrame, state: DataFrame, blocks: int, free) -> DataFrame:
        """One round over the nodes that ``links`` leave."""
        sums = state.groupBy("community").agg(F.sum("weight").alias("held"), F.count("*").alias("members"))
        known = state.join(sums, "community")
        near = links.select("block", F.col("src").alias("node"), F.lit(True).alias("mine")).unionByName(links.select("block", F.col("dst").alias("node"), F.lit(False).alias("mine")))
        near = near.groupBy("block", "node").agg(F.max("mine").alias("mine"))
        return _dealt(links, near.join(known, "node").withColumn("free", free), blocks, work, "node long, next long, wants boolean")

    blocks, state = -(-count // most), start
    for turn in range(SAFETY):
        block = F.pmod(F.xxhash64("src", F.lit(turn)), F.lit(blocks)).cast("int").alias("block")
        free = F.pmod(F.xxhash64("node", F.lit(-turn - 1)), F.lit(2)) == 0
        links = edges.select(block, "src", "dst", "w")
        found = state.join(round_of(links, state, blocks, free), "node", "left")
        moved = written(found.select("node", "weight", "within", "community", F.coalesce("next", "community").alias("next"), F.coalesce("wants", F.lit(False)).alias("wants")), "moving")
        wanting = moved.where("wants").select(F.col("node").alias("src"))
        few = edges.join(wanting, "src", "left_semi")
        asked = few.count()
        if asked == 0:
            return moved.select("node", "weight", "within", "community")
        if asked <= most:
            # others fill the block, so that what the moves bring about is followed there
            others = edges.where(F.pmod(F.xxhash64("src", F.lit(turn)), F.lit(1_000_000)) < int(1_000_000 * (most - asked) / count))
            few = few.unionByName(others.join(wanting, "src", "left_anti").select(*few.columns))
            alone = round_of(few.select(F.lit(0).cast("int").alias("block"), "src", "dst", "w"), state, 1, F.lit(True))
            after = state.join(alone, "node", "left").select("node", "weight", "within", F.coalesce("next", "community").alias("community"))
            after = written(after, "moving")
        else:
            after = moved.select("node", "weight", "within", F.col("next").alias("community"))
            after._written_at = moved._written_at
        if asked <= most:
            drop_written(moved)
        if state is not start:
            drop_written(state)
        state = after
    raise RuntimeError(f"communities still move after {SAFETY} rounds")


def communities(edges: DataFrame, gamma: float | None = None, refine: bool = True, src: str = "src", dst: str = "dst", block: int = BLOCK) -> DataFrame:
    """``node, community`` of an undirected graph of long ids; parallel edges add up. ``gamma``: constant Potts model;
    ``refine``: Leiden, else Louvain. ``block``: links that one task holds.

    Communities are parted into their connected pieces at the end, so each is connected, and named by their least node.
    """
    links = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null and src <> dst")
    both = links.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
    base = graph = written(both.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")), "graph")
    count, total = base.agg(F.count("*"), F.sum("w")).first()
    per = gamma if gamma is not None else 1 / (total or 1.0)
    weight = F.lit(1.0) if gamma is not None else F.sum("w")
    state = graph.groupBy(F.col("src").alias("node")).agg(weight.alias("weight")).select("node", "weight", F.lit(0).cast("long").alias("within"), F.col("node").alias("community"))
    if count <= block:
        return written(_at_once(graph, state, per, refine, True), "labels")
    state = written(state, "state")
    labels = written(state.select("node", F.col("node").alias("inner")), "labels")  # which node of the present graph holds it
    while count > block:
        settled = _settled(graph, state, count, per, False, block)
        joined = settled.groupBy("community").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        if joined:
            break
        if refine:
            begin = written(settled.select("node", "weight", F.col("community").alias("within"), F.col("node").alias("community")), "state")
            parts = _settled(graph, begin, count, per, True, block)
            if parts.where("node <> community").isEmpty():  # nothing to put together: the communities themselves go on
                parts = settled.withColumn("within", F.col("community"))
        else:
            parts = settled.withColumn("within", F.col("community"))
        mapping = parts.select(F.col("node").alias("inner"), F.col("community").alias("next"))
        labels = written(labels.join(mapping, "inner").select("node", F.col("next").alias("inner")), "labels", replaces=labels)
        ends = lambda end: parts.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))  # noqa: E731,B023
        graph = written(
            graph.join(ends("src"), "src").join(ends("dst"), "dst").where("c_src <> c_dst")
            .groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("w").alias("w")),
            "graph",
        )
        # a part begins in its community, named by the least of the community's parts
        groups = parts.groupBy("community", "within").agg(F.sum("weight").alias("weight"))
        names = groups.groupBy("within").agg(F.min("community").alias("name"))
        state = written(
            groups.join(names, "within").select(F.col("community").alias("node"), "weight", F.lit(0).cast("long").alias("within"), F.col("name").alias("community")), "state"
        )
        count = graph.count()
    else:
        settled = _at_once(graph, state, per, refine, False)
    final = settled.select(F.col("node").alias("inner"), "community")
    labels = written(labels.join(final, "inner").select("node", "community"), "labels")
    side = lambda end: labels.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    inner = base.where("src < dst").join(side("src"), "src").join(side("dst"), "dst").where("c_src = c_dst").select("src", "dst")
    pieces = components(inner)
    return labels.join(pieces, "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def potts(edges: DataFrame, membership: DataFrame, gamma: float, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row ``quality`` of a labelling under the constant Potts model: edges inside less gamma for each inner pair."""
    of = lambda end: membership.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    rows = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").join(of("src"), "src").join(of("dst"), "dst")
    inner = rows.agg(F.count_if(F.col("c_src") == F.col("c_dst")).alias("inner"))
    pairs = membership.groupBy("community").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    return inner.crossJoin(F.broadcast(pairs)).select((F.col("inner") - gamma * F.col("pairs")).alias("quality"))  # one row each


def inside_counts(edges: DataFrame, membership: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``community, nodes, inner, cut``: per community its nodes, the edges inside and those that leave it."""
    of = lambda end: membership.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    rows = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).join(of("src"), "src").join(of("dst"), "dst")
    ends = rows.select(F.explode(F.array_distinct(F.array("c_src", "c_dst"))).alias("community"), (F.col("c_src") == F.col("c_dst")).alias("same"))
    counts = ends.groupBy("community").agg(F.count_if("same").alias("inner"), F.count_if(~F.col("same")).alias("cut"))
    nodes = membership.groupBy("community").agg(F.count("*").alias("nodes"))
    return nodes.join(counts, "community", "left").select("community", "nodes", F.coalesce("inner", F.lit(0)).alias("inner"), F.coalesce("cut", F.lit(0)).alias("cut"))


def at_least(membership: DataFrame, size: int) -> DataFrame:
    """Nodes of communities of at least so many nodes."""
    large = membership.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= size).select("community")
    return membership.join(large, "community", "left_semi").select("node", "community")


def touching(membership: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """All nodes of the communities that hold one of the nodes."""
    hit = membership.join(nodes.select(F.col(node).alias("node")).distinct(), "node", "left_semi").select("community").distinct()
    return membership.join(hit, "community", "left_semi").select("node", "community")

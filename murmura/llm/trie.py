"""A prefix tree of globally ordered sets, and the similarity join that walks it.

Sets that begin alike share nodes, so what a probe has in common with a shared
beginning is counted once. A probe leaves a subtree as soon as what it has in common
so far, and the most that can still follow on both sides, are too few for any set
below; and where all sets below are linked to it already. All probes of a batch walk
together, level by level, as arrays.
"""

from __future__ import annotations

import numpy as np

from murmura.llm import kernels as K

#: Depths at which nodes begin: densely where walks end mostly, then every EDGE members. Pairs of probe and node expanded at once; probes of a batch from one group.
FIRST, EDGE, WIDE, BATCH = (0, 4, 8, 16), 32, 1 << 16, 64


def _shared_beginnings(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many leading members each set has in common with the one before it; 0 for the first."""
    out = np.zeros(len(at) - 1, np.int64)
    size = np.diff(at)
    both = np.minimum(size[:-1], size[1:])
    i = K.positions(both)
    pair = np.repeat(np.arange(len(both)), both)
    differ = np.flatnonzero(rank[at[pair] + i] != rank[at[pair + 1] + i])
    out[1:] = both
    np.minimum.at(out, pair[differ] + 1, i[differ])
    return out


def _lists(owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Things by owner: their order, where each owner's begin in it, and how many each has."""
    many = np.bincount(owner, minlength=owners)
    return np.argsort(owner, kind="stable"), np.cumsum(many) - many, many


class Forest:
    """Prefix trees of the sets of several groups, in arrays.

    ``group``, ``rank`` and ``at`` are sorted: sets by group, then as sequences;
    rank[at[i]:at[i + 1]] are set i's members, ascending. ``n`` are the sets' sizes,
    members that no other set has included. A node covers the members from one of the
    fixed depths to the next, or to the set's end; sets that agree up to there share
    it, and lie side by side. Each group has a root that covers nothing.
    """

    def __init__(self, group: np.ndarray, rank: np.ndarray, at: np.ndarray, n: np.ndarray):
        size, sets = np.diff(at), np.arange(len(n))
        same = _shared_beginnings(rank, at)
        new = np.concatenate([[True], group[1:] != group[:-1]])
        same[new] = -1
        depths = np.array([*FIRST, *range(EDGE, int(size.max()) + EDGE, EDGE)])
        begins, ends, firsts, lasts, parents = [], [], [], [], []
        node = np.cumsum(new) - 1  # of each set, so far
        made = 0

        def add(begin: int, end: np.ndarray, first: np.ndarray, last: np.ndarray, parent: np.ndarray) -> None:
            begins.append(np.full(len(first), begin))
            for x, y in ((ends, end), (firsts, first), (lasts, last), (parents, parent)):
                x.append(y)

        heads = np.flatnonzero(new)
        self.groups = group[heads]
        add(0, np.zeros(len(heads), np.int64), heads, np.append(heads[1:], len(n)) - 1, np.full(len(heads), -1))
        made = len(heads)
        for begin, stop in zip(depths[:-1], depths[1:]):
            here = sets[size > begin]
            if not len(here):
                break
            end = np.minimum(size[here], stop)
            before = np.where(here > 0, np.minimum(size[here - 1], stop), -1)
            head = np.flatnonzero((same[here] < end) | (before != end))
            add(int(begin), end[head], here[head], here[np.append(head[1:], len(here)) - 1], node[here[head]])
            node[here] = made + np.repeat(np.arange(len(head)), np.diff(np.append(head, len(here))))
            made += len(head)
        self.begin, self.end, self.first, self.last, parent = (np.concatenate(x) for x in (begins, ends, firsts, lasts, parents))
        order, at_child, self.children = _lists(parent + 1, made + 1)
        self.child, self.child_at, self.children = order, at_child[1:], self.children[1:]
        self.over, self.over_at, self.overs = _lists(node, made)
        self.rank, self.at = rank, at
        self.least, self.most = _ranged(n, self.first, self.last, np.minimum), _ranged(n, self.first, self.last, np.maximum)
        self.rest = _ranged(size, self.first, self.last, np.maximum) - self.end

    def below(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of each node: which of the nodes asked for, and the child."""
        many = self.children[node]
        return np.repeat(np.arange(len(node)), many), self.child[np.repeat(self.child_at[node], many) + K.positions(many)]

    def ending(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets that end with each node: which of the nodes asked for, and the set."""
        many = self.overs[node]
        return np.repeat(np.arange(len(node)), many), self.over[np.repeat(self.over_at[node], many) + K.positions(many)]


def _table(values: np.ndarray, best) -> list[np.ndarray]:
    rows = [values]
    while (step := 1 << len(rows) - 1) * 2 <= len(values):
        rows.append(best(rows[-1][:-step], rows[-1][step:]))
    return rows


def _ranged(values: np.ndarray, first: np.ndarray, last: np.ndarray, best) -> np.ndarray:
    rows = _table(values, best)
    level = np.floor(np.log2(last - first + 1)).astype(np.int64)
    out = np.empty(len(first), np.int64)
    for k in np.unique(level):
        on = level == k
        out[on] = best(rows[k][first[on]], rows[k][last[on] + 1 - (1 << k)])
    return out


class Labels:
    """Components of labelled things, merged as links come."""

    def __init__(self, label: np.ndarray):
        self.label = label.copy()

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links things ``a`` to things ``b``."""
        pairs = np.unique(np.stack([self.label[a], self.label[b]], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for x, y in pairs.tolist():
            x, y = top(x), top(y)
            parent[max(x, y)] = min(x, y)
        if parent:
            old = np.array(sorted(parent))
            new = np.array([top(x) for x in old.tolist()])
            at = np.minimum(np.searchsorted(old, self.label), len(old) - 1)
            self.label = np.where(old[at] == self.label, new[at], self.label)


def linked(group: np.ndarray, members: np.ndarray, at: np.ndarray, n: np.ndarray, label: np.ndarray, stores: np.ndarray, probes: np.ndarray, percent: int) -> np.ndarray:
    """The labels of all sets after each group's stored sets and probes of a similarity of ``percent`` or more are linked.

    Set i has the ascending members[at[i]:at[i + 1]] and n[i] members in all; label
    tells what is linked already and gets the least label of what is linked in the
    end. Every similar pair ends up under one label, though only pairs that are not
    yet linked are looked at; probes go in the order given.
    """
    found = Labels(label)
    if not len(group):
        return found.label
    values, rank = np.unique(members, return_inverse=True)
    span, size = len(values) + 1, np.diff(at)
    key = np.repeat(np.arange(len(group)), size) * span + rank  # ascending: a probe's members, probe by probe
    held = np.flatnonzero(stores)
    spelled = [rank[at[i] : at[i + 1]].astype(">u4").tobytes() for i in held]
    held = held[sorted(range(len(held)), key=lambda j: (group[held[j]], spelled[j]))]
    if not len(held):
        return found.label
    inside = np.repeat(at[held], size[held]) + K.positions(size[held])
    forest = Forest(group[held], rank[inside], np.concatenate([[0], np.cumsum(size[held])]), n[held])
    place = np.full(len(group), -1)
    place[held] = np.arange(len(held))
    root_of = np.full(int(group.max()) + 1, -1)
    root_of[forest.groups] = np.arange(len(forest.groups))

    asking = np.flatnonzero(probes & (root_of[group] >= 0))
    turn = K.positions(np.bincount(group[asking]))[np.argsort(np.argsort(group[asking], kind="stable"), kind="stable")]
    done = np.zeros(len(held), bool)
    low, width = 0, 1
    while len(asking):
        now = asking[(turn >= low) & (turn < low + width)]
        _walk(forest, now, held, place, done, root_of[group[now]], key, span, at, n, found, percent)
        done[place[now][place[now] >= 0]] = True
        low, width = low + width, min(2 * width, BATCH)
        # a group whose stored sets and probe are linked to each other has nothing more to say
        of = found.label[held]
        apart = np.concatenate([[0], np.cumsum(of[1:] != of[:-1])])
        root = root_of[group[asking]]
        one = (apart[forest.last[root]] == apart[forest.first[root]]) & (of[forest.first[root]] == found.label[asking])
        stay = (turn >= low) & ~one
        asking, turn = asking[stay], turn[stay]
    return found.label


def _walk(forest: Forest, now: np.ndarray, held: np.ndarray, place: np.ndarray, done: np.ndarray, root: np.ndarray, key: np.ndarray, span: int, at: np.ndarray, n: np.ndarray, found: Labels, percent: int) -> None:
    """Walks the probes ``now`` down their trees and links them to the similar sets they reach."""
    of = found.label[held]
    apart = np.concatenate([[0], np.cumsum(of[1:] != of[:-1])])
    past = np.concatenate([[0], np.cumsum(done)])
    todo = [(now, root, np.zeros(len(now), np.int64))]
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    while todo:
        probe, node, common = todo.pop()
        if len(probe) > WIDE:
            cut = len(probe) // 2
            todo += [(probe[:cut], node[:cut], common[:cut]), (probe[cut:], node[cut:], common[cut:])]
            continue
        first, last = forest.first[node], forest.last[node]
        settled = (apart[last] == apart[first]) & (of[first] == found.label[probe])
        asked = (past[last + 1] - past[first] == last - first + 1) & (place[probe] >= 0)  # a stored set that has walked met all others
        near = (100 * forest.most[node] >= percent * n[probe]) & (percent * forest.least[node] <= 100 * n[probe])
        keep = np.flatnonzero(~settled & ~asked & near)
        probe, node, common = probe[keep], node[keep], common[keep]
        if not len(probe):
            continue
        size = forest.end[node] - forest.begin[node]
        many = np.flatnonzero(size)
        rest = at[probe + 1] - at[probe]
        if len(many):
            step = size[many]
            where = np.repeat(forest.at[forest.first[node[many]]] + forest.begin[node[many]], step) + K.positions(step)
            asked_for = np.repeat(probe[many] * span, step) + forest.rank[where]
            got = np.searchsorted(key, asked_for)
            hit = key[np.minimum(got, len(key) - 1)] == asked_for
            ends = np.cumsum(step)
            common[many] += np.add.reduceat(hit.astype(np.int64), ends - step)
            rest[many] = at[probe[many] + 1] - (got[ends - 1] + hit[ends - 1])
        rest[size == 0] = np.iinfo(np.int64).max
        most = common + np.minimum(rest, forest.rest[node])
        need = -(-percent * (n[probe] + forest.least[node]) // (100 + percent))
        keep = np.flatnonzero(most >= need)
        probe, node, common = probe[keep], node[keep], common[keep]
        pair, ended = forest.ending(node)
        like = common[pair] * (100 + percent) >= percent * (n[probe[pair]] + n[held[ended]])
        hits.append((probe[pair[like]], held[ended[like]]))
        pair, child = forest.below(node)
        if len(pair):
            todo.append((probe[pair], child, common[pair]))
    if hits:
        found.merge(*(np.concatenate(x) for x in zip(*hits)))

"""Label propagation within components that fit into a task: each is followed until one of its states comes back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of votes that are followed together, at least; components are never cut.
TOGETHER = 1 << 16


def _mixed(node: np.ndarray, label: np.ndarray, salt: int) -> np.ndarray:
    x = node * np.uint64(0x9E3779B97F4A7C15) + label * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _marks(label: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 bits of each component's state (components x 2)."""
    node, label = np.arange(len(label), dtype=np.uint64), label.astype(np.uint64)
    return np.stack([np.add.reduceat(_mixed(node, label, salt), starts) for salt in (1, 2)], 1)


def _voted(src: np.ndarray, dst: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The labels after a round of votes src <- dst: the most frequent one, the lowest of equals."""
    key = np.sort(src * len(label) + label[dst])
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    votes, node, voted = np.diff(np.r_[first, len(key)]), key[first] // len(label), key[first] % len(label)
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    most = np.repeat(np.maximum.reduceat(votes, starts), np.diff(np.r_[starts, len(node)]))
    best = np.flatnonzero(votes == most)
    best = best[np.r_[True, node[best][1:] != node[best][:-1]]]
    out = label.copy()
    out[node[best]] = voted[best]
    return out


def followed(component: np.ndarray, src: np.ndarray, dst: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Each component's first state that comes back and its period (0: none within ``rounds``), and the states of a period as (nodes, labels), in order.

    component: of each node, ascending; src, dst: votes. States count from 0, where all nodes have their own label. Of a component
    without a period the states are the last two.
    """
    n = len(component)
    starts = np.flatnonzero(np.r_[True, component[1:] != component[:-1]])
    sizes = np.diff(np.r_[starts, n])
    which = np.repeat(np.arange(len(starts)), sizes)
    label = np.arange(n)
    back, period, since = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    marks, active = [_marks(label, starts)], np.ones(len(starts), bool)
    nodes, labels, done = [], [], 0
    while active.any():
        before, done = label, done + 1
        label = _voted(src, dst, label)
        if done <= rounds and (waiting := np.flatnonzero(active & (since < 0))).size:
            now = _marks(label, starts)
            for s, old in enumerate(marks):
                same = waiting[(old[waiting] == now[waiting]).all(1)]
                back[same], period[same], since[same] = s, done - s, done
            marks.append(now)
        kept = np.flatnonzero((active & (since >= 0))[which])
        nodes.append(kept)
        labels.append(label[kept])
        active &= ~((since >= 0) & (done - since >= period - 1))
        if done >= rounds and (late := active & (since < 0)).any():
            kept = np.flatnonzero(late[which])
            nodes += [kept, kept]
            labels += [before[kept], label[kept]]
            active &= ~late
        if (still := active[which[src]]).mean() < 0.5:
            src, dst = src[still], dst[still]
    return back[which], period[which], nodes, labels


def follower(rounds: int):
    """Kernel: (component, node, neighbour) sorted by all three to (node, back, period, labels)."""

    def solved(rows: pa.Table) -> pa.RecordBatch:
        component, node, neighbour = (rows.column(i).combine_chunks() for i in range(3))
        new = np.r_[True, pc.not_equal(node.slice(1), node.slice(0, len(node) - 1)).to_numpy(zero_copy_only=False)]
        names = node.filter(pa.array(new))
        src, dst = np.cumsum(new) - 1, pc.index_in(neighbour, names).to_numpy(zero_copy_only=False).astype(np.int64)
        own = component.filter(pa.array(new))
        other = np.r_[True, pc.not_equal(own.slice(1), own.slice(0, len(own) - 1)).to_numpy(zero_copy_only=False)]
        back, period, nodes, labels = followed(np.cumsum(other), src, dst, rounds)
        at, label = np.concatenate(nodes), np.concatenate(labels)
        order = np.argsort(at, kind="stable")
        offsets = pa.array(np.searchsorted(at[order], np.arange(len(names) + 1)).astype(np.int32))
        return pa.record_batch([names, pa.array(back), pa.array(period), pa.ListArray.from_arrays(offsets, names.take(pa.array(label[order])))], ["node", "back", "period", "labels"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows, most = [], 0, TOGETHER
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows < most:
                continue
            table = pa.Table.from_batches(waiting).combine_chunks()
            last = pc.index(table.column(0), table.column(0)[rows - 1]).as_py()  # the last component may go on
            if last:
                yield solved(table.slice(0, last))
            waiting, rows = table.slice(last).to_batches(), rows - last
            most = max(TOGETHER, 2 * rows)
        if rows:
            yield solved(pa.Table.from_batches(waiting))

    return kernel

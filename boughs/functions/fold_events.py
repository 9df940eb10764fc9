"""Evaluate runs of fold events. The helper behind the chunk jobs.

An event is an open with a node value, a close, or a finished value that belongs to the innermost open
node. A chunk of tokens is a run of opens and closes. A partial result is a run too (finished value and
close alternate, then the nodes left open with what their finished children multiply to), so that
evaluating the events of neighbouring partials in order merges them. The result of a run is

* ``cs``: results finished outside any node opened in the run, one entry per level, shallowest first;
* ``opens``: nodes left open with the product of their finished children, shallowest first.

``has`` flags tell "no child yet" apart from any value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .algebra import BatchForm, TreeAlgebra

OPEN, VALUE, CLOSE = 1, 0, -1


@dataclass
class Events:
    """Flat events of many runs: run ``i`` covers ``offsets[i]:offsets[i + 1]``."""

    kind: np.ndarray
    values: np.ndarray | list
    offsets: np.ndarray


@dataclass
class Partials:
    """Results of many runs as Arrow arrays: value columns flat, one row of offsets per run."""

    cs_offsets: np.ndarray
    cs_v: pa.Array
    cs_has: np.ndarray
    open_offsets: np.ndarray
    open_a: pa.Array
    open_v: pa.Array
    open_has: np.ndarray


def _concat_offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _running_depth(ev: Events) -> np.ndarray:
    """Net depth after each event, counted from the start of its run."""
    running = np.concatenate([[0], np.cumsum(ev.kind, dtype=np.int64)])
    return running[1:] - np.repeat(running[ev.offsets[:-1]], np.diff(ev.offsets))


def fold_by_level(ev: Events, form: BatchForm) -> Partials:
    """Fold all runs at once, one numpy step per tree level, deepest level first."""
    kind, values, n = ev.kind, ev.values, len(ev.kind)
    n_runs = len(ev.offsets) - 1
    sizes = np.diff(ev.offsets)
    run = np.repeat(np.arange(n_runs), sizes)
    after = _running_depth(ev)
    level = after - (kind == OPEN)

    # level order: siblings of a run lie next to each other, and a close right behind its open
    order = np.lexsort((run, level))
    o_kind, o_level, o_run = kind[order], level[order], run[order]
    new_slot = np.ones(n, dtype=bool)
    new_slot[1:] = (o_level[1:] != o_level[:-1]) | (o_run[1:] != o_run[:-1])
    matched = np.zeros(n, dtype=bool)
    matched[:-1] = (o_kind[:-1] == OPEN) & (o_kind[1:] == CLOSE) & ~new_slot[1:]

    first = np.zeros(n, dtype=bool)
    first[ev.offsets[:-1][sizes > 0]] = True
    behind_open = np.zeros(n, dtype=bool)
    behind_open[1:] = kind[:-1] == OPEN
    behind_open &= ~first
    starts_family = behind_open[order] & (o_kind != CLOSE)
    family = np.cumsum(new_slot | starts_family) - 1

    item = np.flatnonzero((o_kind == VALUE) | matched)  # finished results, in level order
    item_token, item_level, item_family = order[item], o_level[item], family[item]
    head = np.ones(len(item), dtype=bool)
    head[1:] = item_family[1:] != item_family[:-1]
    head_at = np.flatnonzero(head)
    # a family behind an open belongs to that node; otherwise its parent was opened before the run
    fam_first = np.flatnonzero(new_slot | starts_family)
    fam_parent = np.where(starts_family[fam_first], order[fam_first] - 1, -1)
    parent = fam_parent[item_family[head_at]]

    kids = np.zeros_like(values)
    has_kids = np.zeros(n, dtype=bool)
    finished = np.zeros((len(head_at), *values.shape[1:]), dtype=values.dtype)

    bounds = np.flatnonzero(np.diff(item_level)) + 1
    edges = np.concatenate([[0], bounds, [len(item)]]) if len(item) else np.array([0])
    for lo, hi in zip(edges[-2::-1], edges[:0:-1]):
        tok = item_token[lo:hi]
        out = values[tok].copy()
        node = kind[tok] == OPEN
        leaf, inner = node & ~has_kids[tok], node & has_kids[tok]
        if leaf.any():
            out[leaf] = form.hom(out[leaf])
        if inner.any():
            out[inner] = form.plus(out[inner], kids[tok[inner]])
        h0, h1 = np.searchsorted(head_at, (lo, hi))
        runs = form.mult_runs(out, head_at[h0:h1] - lo)
        finished[h0:h1] = runs
        up = parent[h0:h1]
        kids[up[up >= 0]] = runs[up >= 0]
        has_kids[up[up >= 0]] = True

    lowest = np.zeros(n_runs, dtype=np.int64)
    if n:
        filled = np.flatnonzero(sizes > 0)
        lowest[filled] = np.minimum(0, np.minimum.reduceat(after, ev.offsets[:-1][filled]))
    cs_offsets = _concat_offsets(1 - lowest)
    loose = np.flatnonzero(parent < 0)
    at = head_at[loose]
    loose_run = o_run[item[at]]
    slot = cs_offsets[loose_run] + item_level[at] - lowest[loose_run]
    cs_v = np.zeros((cs_offsets[-1], *values.shape[1:]), dtype=values.dtype)
    cs_has = np.zeros(cs_offsets[-1], dtype=bool)
    cs_v[slot], cs_has[slot] = finished[loose], True

    left = np.zeros(n, dtype=bool)
    left[order[(o_kind == OPEN) & ~matched]] = True
    left = np.flatnonzero(left)
    return Partials(
        cs_offsets,
        form.to_arrow(cs_v, cs_has),
        cs_has,
        _concat_offsets(np.bincount(run[left], minlength=n_runs)),
        form.to_arrow(values[left], np.ones(len(left), dtype=bool)),
        form.to_arrow(kids[left], has_kids[left]),
        has_kids[left],
    )


def fold_by_stack(ev: Events, algebra: TreeAlgebra, a_type: pa.DataType, v_type: pa.DataType) -> Partials:
    """Fold run by run with the scalar functions: user algebras, and runs as deep as they are long."""
    cs_n, cs_v, cs_has, open_n, open_a, open_v, open_has = [], [], [], [], [], [], []
    hom, plus, mult = algebra.hom, algebra.plus, algebra.mult
    for lo, hi in zip(ev.offsets[:-1].tolist(), ev.offsets[1:].tolist()):
        done: list = [[None, False]]  # deepest first
        stack: list = []
        for k, x in zip(ev.kind[lo:hi].tolist(), ev.values[lo:hi]):
            if k == OPEN:
                stack.append([x, None, False])
                continue
            if k == CLOSE:
                if not stack:
                    done.append([None, False])
                    continue
                a, v, has = stack.pop()
                x = plus(a, v) if has else hom(a)
            top = stack[-1] if stack else done[-1]
            top[-2] = mult(top[-2], x) if top[-1] else x
            top[-1] = True
        cs_n.append(len(done))
        open_n.append(len(stack))
        for v, has in reversed(done):
            cs_v.append(v)
            cs_has.append(has)
        for a, v, has in stack:
            open_a.append(a)
            open_v.append(v)
            open_has.append(has)
    return Partials(
        _concat_offsets(np.array(cs_n, dtype=np.int64)),
        pa.array(cs_v, v_type),
        np.array(cs_has, dtype=bool),
        _concat_offsets(np.array(open_n, dtype=np.int64)),
        pa.array(open_a, a_type),
        pa.array(open_v, v_type),
        np.array(open_has, dtype=bool),
    )


def fold_events(ev: Events, algebra: TreeAlgebra, a_type: pa.DataType, v_type: pa.DataType) -> Partials:
    if algebra.batch is None:
        return fold_by_stack(ev, algebra, a_type, v_type)
    # a numpy step costs about as much as 64 stack steps; a run of mere opens has a level per event
    depth = _running_depth(ev)
    if len(depth) == 0 or int(depth.max() - depth.min()) * 64 < len(depth) + 4096:
        return fold_by_level(ev, algebra.batch)
    rows = Events(ev.kind, algebra.batch.scalars(ev.values), ev.offsets)
    return fold_by_stack(rows, algebra, a_type, v_type)


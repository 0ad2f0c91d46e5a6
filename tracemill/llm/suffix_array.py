"""Suffix arrays by linear grouping: suffixes are grouped by their Lyndon prefix, then every group's order is emitted.

Phase 1 starts with a group for each first symbol and goes through the groups from the highest to the lowest. A suffix of the present
group hangs below its previous smaller suffix, the last position before it that is in a lower group. A position that n suffixes
of the group hang below has the group's prefix n times behind its own, so it leaves its group for a new one directly above it,
the higher the larger n. When all groups are done, a group's suffixes begin with the same Lyndon word, and groups are in order.

Phase 2 emits suffixes from the smallest on. The one before an emitted suffix, and those that it hangs below as far as they are not
emitted, end their Lyndon prefixes where the emitted suffix begins, so they are the next of their groups. Nothing is renamed or
sorted recursively, and each suffix is placed once.

Many independent strings are sorted side by side: a step of either phase is a step of every string, on numpy arrays.
"""

from __future__ import annotations

import numpy as np


#: Strings below which phase 2 goes on with one after another, as a step of few is no less work than one of many.
FEW = 16


def _where(mask: np.ndarray) -> np.ndarray:
    return mask.nonzero()[0]


def suffix_arrays(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions in `symbols` of all strings' suffixes, string after string, each string's from its smallest suffix to its largest.

    symbols: non-negative integers, the strings one after another; sizes: their lengths, none of them zero.
    """
    if not len(sizes):
        return np.empty(0, dtype=np.int64)
    text, first = _padded(np.asarray(symbols, dtype=np.int64), np.asarray(sizes, dtype=np.int64))
    order, start, hangs = _groups(text, first)
    out = _emitted(order, start, hangs, first)
    real = text[out] > 1  # neither the cell before a string nor the end mark
    before = np.repeat(2 * np.arange(len(sizes)) + 1, sizes)  # cells that do not belong to the text, up to each symbol
    return out[real] - before


def _padded(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings with a cell before each (0) and an end mark behind (1), all symbols above these, and where each begins."""
    first = np.concatenate([[0], np.cumsum(sizes + 2)])
    text = np.zeros(first[-1], dtype=np.int32)
    text[first[1:] - 1] = 1
    text[np.arange(len(symbols)) + np.repeat(2 * np.arange(len(sizes)) + 1, sizes)] = symbols + 2
    return text, first


def _runs(values: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin."""
    return _where(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, dtype=np.int64)


def _groups(text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: positions by group, the place where each position's group begins, and what each position hangs below."""
    n, base = len(text), first[:-1]
    owner = np.repeat(np.arange(len(base)), np.diff(first))
    order = (owner * (int(text.max()) + 1) + text).argsort(kind="stable").astype(np.int32)  # the cell before a string is the first of its places
    place = np.empty(n, dtype=np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    head = _runs(owner[order] * (int(text.max()) + 1) + text[order])
    size = np.zeros(n, dtype=np.int32)
    size[head] = np.diff(np.append(head, n))
    start = np.empty(n, dtype=np.int32)
    start[order] = np.repeat(head, size[head])
    hangs = np.arange(-1, n - 1, dtype=np.int32)
    top, live = first[1:].copy(), np.arange(len(base))  # a string's groups from `top` on are done
    while len(live):
        low = start[order[top[live] - 1]]
        many = top[live] - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        top[live] = low
        members, floor = order[at], np.repeat(low, many)
        live = live[low - 1 > base[live]]
        below = hangs[members]
        todo = _where(start[below] >= floor)
        while len(todo):  # members of the same group shorten each other's ways
            below[todo] = hangs[below[todo]]
            hangs[members[todo]] = below[todo]
            todo = todo[start[below[todo]] >= floor[todo]]
        held = np.sort(below[text[below] > 0])  # nothing moves in the cell before a string
        if not len(held):
            continue
        head = _runs(held)
        held, times = held[head], np.diff(np.append(head, len(held)))
        by = np.lexsort((times, start[held]))
        held, times = held[by], times[by]
        old = start[held]
        head = _runs(old)
        moved = np.diff(np.append(head, len(old)))
        end = old[head] + size[old[head]]
        slots = np.repeat(end - moved - head, moved) + np.arange(len(held))
        out = place[held] < np.repeat(end - moved, moved)  # not among its group's last places yet
        marked = np.zeros(len(held), dtype=bool)
        inside = ~out
        marked[place[held[inside]] - np.repeat(end - moved - head, moved)[inside]] = True
        leaving, gap = order[slots[~marked]], place[held[out]]
        order[gap], place[leaving] = leaving, gap
        order[slots], place[held] = held, slots
        size[old[head]] -= moved
        fresh = _where(np.concatenate([[True], (old[1:] != old[:-1]) | (times[1:] != times[:-1])]))
        length = np.diff(np.append(fresh, len(held)))
        start[held] = np.repeat(slots[fresh], length)
        size[slots[fresh]] = length
    return order, start, hangs


def _emitted(order: np.ndarray, start: np.ndarray, hangs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Phase 2: all positions from each string's smallest suffix to its largest (the cell before a string comes first)."""
    out = order.copy()
    free = start[order]  # by the place where a group begins: its next free place
    base, end = first[:-1], first[1:]
    done = np.zeros(len(order), dtype=bool)
    done[base] = done[end - 1] = True  # the cell before, and the end mark, which is the smallest suffix
    live = np.arange(len(base))
    at, p = base + 1, end - 2
    while len(live) > FEW:
        stuck = done[p]
        go = _where(~stuck)
        q = p[go]
        g = start[q]
        out[free[g]] = q
        free[g] += 1
        done[q] = True
        p[go] = hangs[q]
        rest = _where(stuck)
        if len(rest):
            at[rest] += 1
            last = end[live[rest]] - 1
            over = at[rest] > last
            p[rest] = out[np.minimum(at[rest], last)] - 1
            if over.any():
                stay = np.ones(len(live), dtype=bool)
                stay[rest[over]] = False
                live, at, p = live[stay], at[stay], p[stay]
    for s, now, q in zip(live.tolist(), at.tolist(), p.tolist()):
        x, y = int(base[s]), int(end[s])
        _emit_one(out, free, done, start, hangs, x, y, now, q)
    return out


def _emit_one(out: np.ndarray, free: np.ndarray, done: np.ndarray, start: np.ndarray, hangs: np.ndarray, x: int, y: int, now: int, q: int) -> None:
    """The rest of phase 2 for the string at x..y-1, from place `now` on, where q is looked at next."""
    o, f, seen, g, h = (a[x:y].tolist() for a in (out, free, done, start, hangs))
    now, q = now - x, q - x
    while True:
        while not seen[q]:
            at = g[q] - x
            o[f[at] - x] = q + x
            f[at] += 1
            seen[q] = True
            q = h[q] - x
        now += 1
        if now == y - x:
            break
        q = o[now] - 1 - x
    out[x:y] = o

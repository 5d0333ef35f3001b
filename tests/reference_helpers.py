"""Slow, plain versions of the operators, to compare with on small rasters."""

from collections import deque

import numpy as np

SIDES = [(-1, 0), (0, -1), (0, 1), (1, 0)]
ALL = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def label(grid, steps):
    out = np.zeros(grid.shape, int)
    n = 0
    for y, x in zip(*np.nonzero(grid)):
        if out[y, x]:
            continue
        n += 1
        out[y, x] = n
        queue = deque([(y, x)])
        while queue:
            a, b = queue.popleft()
            for dy, dx in steps:
                c, d = a + dy, b + dx
                if 0 <= c < grid.shape[0] and 0 <= d < grid.shape[1] and not out[c, d] and grid[c, d] == grid[a, b]:
                    out[c, d] = n
                    queue.append((c, d))
    return out


def squared_distance(grid):
    by, bx = np.nonzero(grid == 0)
    return {
        (y, x): int(((by - y) ** 2 + (bx - x) ** 2).min()) for y, x in zip(*np.nonzero(grid))
    }


def grow(axon, fibre, seeds):
    """Level by level, smallest label on ties: inside the axon pixels, then everywhere."""
    lab = np.zeros(axon.shape, int)

    def run(mask):
        while True:
            new = {}
            for y, x in zip(*np.nonzero((lab > 0) & mask)):
                for dy, dx in SIDES:
                    c, d = y + dy, x + dx
                    if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not lab[c, d]:
                        new[c, d] = min(new.get((c, d), 10**9), lab[y, x])
            if not new:
                return
            for k, v in new.items():
                lab[k] = v

    for (y, x), s in seeds.items():
        if axon[y, x]:
            lab[y, x] = s
    run(axon > 0)
    for (y, x), s in seeds.items():
        if fibre[y, x] and not axon[y, x]:
            lab[y, x] = s
    run(fibre > 0)
    return lab


def to_array(df, shape, column="label", image=0):
    out = np.zeros(shape, int)
    for r in df.filter(f"image_id = {image}").collect():
        out[r["y"], r["x"]] = r[column]
    return out


def flood(axon, fibre, seeds):
    """Highest level on the way, then steps at that level, then the smallest label: by plain rescans."""
    distance = squared_distance(axon) if (axon == 0).any() else {}
    cells = [(y, x) for y, x in zip(*np.nonzero(fibre))]
    level = {c: -distance.get(c, 0) for c in cells}
    seeds = {c: s for c, s in seeds.items() if c in level}
    cost = {c: (level[c], 0) if c in seeds else None for c in cells}
    sides = {c: [n for n in ((c[0] + dy, c[1] + dx) for dy, dx in SIDES) if n in level] for c in cells}

    def onward(a, b):
        top, steps = cost[a]
        return (level[b], 1) if level[b] > top else (top, steps + (level[b] == top))

    changed = True
    while changed:
        changed = False
        for c in cells:
            for near in sides[c]:
                if cost[near] is not None and (cost[c] is None or onward(near, c) < cost[c]):
                    cost[c], changed = onward(near, c), True
    lab = np.zeros(axon.shape, int)
    for c, s in seeds.items():
        lab[c] = s
    changed = True
    while changed:
        changed = False
        for c in cells:
            if cost[c] is None or c in seeds:
                continue
            found = [lab[n] for n in sides[c] if cost[n] is not None and lab[n] and onward(n, c) == cost[c]]
            if found and (not lab[c] or min(found) < lab[c]):
                lab[c], changed = min(found), True
    return lab


def queue_flood(axon, fibre, seeds):
    """Watershed of the negated distance by rescanning the whole queue at every step."""
    distance = squared_distance(axon) if (axon == 0).any() else {}
    lab = np.zeros(axon.shape, int)
    waiting, age = [], 0
    for (y, x), s in seeds.items():
        if fibre[y, x]:
            lab[y, x] = s
            waiting.append((-np.sqrt(distance.get((y, x), 0)), 0, y * axon.shape[1] + x, y, x))
    while waiting:
        first = min(waiting)
        waiting.remove(first)
        for dy, dx in SIDES:
            c, d = first[3] + dy, first[4] + dx
            if 0 <= c < axon.shape[0] and 0 <= d < axon.shape[1] and fibre[c, d] and not lab[c, d]:
                age += 1
                lab[c, d] = lab[first[3], first[4]]
                waiting.append((-np.sqrt(distance.get((c, d), 0)), age, 0, c, d))
    return lab

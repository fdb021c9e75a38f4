"""Plain Python versions of the iterative operators, for small inputs."""

from __future__ import annotations

AROUND = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]
CLOCKWISE = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]


def regions(pixels: set[tuple[int, int]]) -> list[set[tuple[int, int]]]:
    left, found = set(pixels), []
    while left:
        todo = [left.pop()]
        region = set(todo)
        while todo:
            x, y = todo.pop()
            for dx, dy in AROUND:
                spot = (x + dx, y + dy)
                if spot in left:
                    left.discard(spot)
                    region.add(spot)
                    todo.append(spot)
        found.append(region)
    return found


def first_pixel(region: set[tuple[int, int]]) -> tuple[int, int]:
    """(first_y, first_x) in raster order."""
    return min((y, x) for x, y in region)


def walk(region: set[tuple[int, int]]) -> list[tuple[int, int]]:
    start = min(region)
    if len(region) == 1:
        return [start]

    def turn(spot, heading):
        begin = heading - (2 if heading % 2 else 1)
        for k in range(begin, begin + 8):
            dx, dy = CLOCKWISE[k % 8]
            if (spot[0] + dx, spot[1] + dy) in region:
                return k % 8

    spot, heading = start, turn(start, 7)
    first = heading
    path = [start]
    while True:
        dx, dy = CLOCKWISE[heading]
        spot = (spot[0] + dx, spot[1] + dy)
        heading = turn(spot, heading)
        if (spot, heading) == (start, first) or len(path) > 2 + 2 * len(region):
            return path
        path.append(spot)


def grow_groups(pairs: list[tuple[int, int]], times: dict[int, int], members: dict[int, set[int]] | None = None):
    """Order-driven grouping: observations in (time, id) order, groups numbered by their first member."""
    groups_of: dict[int, set[int]] = {}
    for group, ids in (members or {}).items():
        for obs in ids:
            groups_of.setdefault(obs, set()).add(group)
    before: dict[int, list[int]] = {}
    for new, old in pairs:
        before.setdefault(new, []).append(old)
    for new in sorted(before, key=lambda o: (times[o], o)):
        joined = set()
        for old in before[new]:
            joined |= groups_of.setdefault(old, {old})
        groups_of[new] = groups_of.get(new, set()) | joined
    return {(group, obs) for obs, found in groups_of.items() for group in found}

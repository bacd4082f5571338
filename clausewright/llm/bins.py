"""Bin completion over a histogram of lengths.

Bins of one capacity are filled from counts per length, so work and memory depend
on the number of distinct lengths (at most the capacity), not on the number of
pieces.  A filling is applied as often as the counts allow.

``best_fit`` gives the incumbent.  Unless it meets the lower bound, ``complete``
searches: around the largest remaining length it enumerates fillings of the rest of
the bin that no other filling dominates, least waste first, and goes back as soon as
the waste so far rules out fewer bins than the incumbent's.

The search begins with the best ``WIDTH`` fillings of ``STEPS`` steps for each bin.  If
that cut an enumeration short and the lower bound is not met, it begins again with four
times both, until nothing was cut or ``nodes`` branches are spent.  So it is exact with
enough branches, and ``nodes`` alone bounds the work.
"""

from __future__ import annotations

from bisect import bisect_left, insort

#: A filling: ((length, how often in a bin), ...), and the number of bins with it.
Plan = list[tuple[tuple[tuple[int, int], ...], int]]

#: Fillings kept for a branch and steps of one enumeration, at first; branches of the whole search.
WIDTH, STEPS, NODES = 4, 400, 20_000


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by volume, and with items over half the capacity apart."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    for k in [s for s in sizes if 2 * s <= capacity]:  # Martello and Toth's second bound
        alone = sum(counts[s] for s in sizes if s > capacity - k)
        half = sum(counts[s] for s in sizes if capacity - k >= s and 2 * s > capacity)
        room = half * capacity - sum(s * counts[s] for s in sizes if capacity - k >= s and 2 * s > capacity)
        rest = sum(s * counts[s] for s in sizes if k <= s and 2 * s <= capacity)
        best = max(best, alone + half + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit, longest first: each piece goes to the fullest bin that holds it."""
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling: tuple, n: int) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((filling, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                filling, bins = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, filling, bins = capacity, (), -(-left // (capacity // size))
            each = room // size
            full = min(bins, left // each)
            put(room - each * size, (*filling, (size, each)), full)
            left -= full * each
            if full < bins and left:  # the last bin with some of them
                put(room - left * size, (*filling, (size, left)), 1)
                full, left = full + 1, 0
            if filling:
                put(room, filling, bins - full)
    return [x for room in open_ for x in open_[room]]


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether b's items fit into a's as into bins (longest first), so that a is no worse."""
    rooms = sorted(a)
    for x in sorted(b, reverse=True):
        k = bisect_left(rooms, x)
        if k == len(rooms):
            return False
        insort(rooms, rooms.pop(k) - x)
    return True


def fillings(counts: dict[int, int], sizes: list[int], room: int, width: int = WIDTH, steps: int = STEPS) -> tuple[list[tuple[tuple[int, int], ...]], bool]:
    """Undominated fillings of ``room``, least waste first, and whether there may be others."""
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = steps

    def go(room: int, top: int, got: tuple[int, ...]) -> bool:
        nonlocal budget
        k = bisect_left(sizes, min(room, top) + 1) - 1
        grown = False
        while k >= 0 and budget > 0:
            budget -= 1
            s = sizes[k]
            if got.count(s) < counts[s]:
                grown = True
                if go(room - s, s, (*got, s)) and steps <= STEPS:
                    return True
            k -= 1
        if not grown and got:
            found.append((room, got))
        return room == 0

    full = go(room, room, ())  # a full bin dominates the rest of its kind, but not fillings of other items
    found.sort()
    cut = budget <= 0 or full
    kept: list[tuple[int, tuple[int, ...]]] = []
    for waste, f in found:
        if any(_dominates(g, f) for _, g in kept):
            continue
        if len(kept) == width:
            cut = True
            break
        kept.append((waste, f))
    return [tuple((s, f.count(s)) for s in dict.fromkeys(f)) for _, f in kept] or [()], cut


def complete(counts: dict[int, int], capacity: int, incumbent: Plan, least: int, nodes: int = NODES, width: int = WIDTH, steps: int = STEPS) -> tuple[Plan, int, bool]:
    """The best plan found within so many branches (at worst the incumbent), the branches left, and whether an enumeration was cut."""
    cut = False
    total = sum(s * n for s, n in counts.items())
    best, best_bins = incumbent, sum(n for _, n in incumbent)
    left, sizes = dict(counts), sorted(counts)
    trail: list[tuple[list, int, tuple, int]] = []  # branches not yet tried, largest, filling, bins

    def take(filling: tuple, n: int, sign: int) -> None:
        for s, k in filling:
            before = left[s]
            left[s] = before - sign * k * n
            if not before:
                insort(sizes, s)
            elif not left[s]:
                sizes.pop(bisect_left(sizes, s))

    waste, branches = 0, None
    while nodes > 0 and best_bins > least:
        nodes -= 1
        slack = (best_bins - 1) * capacity - total
        if not sizes and waste <= slack:
            best = [(f, n) for _, _, f, n in trail]
            best_bins = sum(n for _, n in best)
            branches = []
        elif branches is None:
            if waste > slack:
                branches = []
            else:
                big = sizes[-1]
                left[big] -= 1
                some = sizes if left[big] else sizes[:-1]
                some, short = fillings(left, some, capacity - big, width, steps)
                branches, cut = [(big, f) for f in some][::-1], cut or short
                left[big] += 1
        if branches:
            big, rest = branches.pop()
            merged = dict(rest)
            merged[big] = merged.get(big, 0) + 1
            filling = tuple(sorted(merged.items(), reverse=True))
            n = min(left[s] // k for s, k in filling) if steps <= STEPS else 1
            cut = cut or n > 1  # the same filling as often as it goes
            take(filling, n, 1)
            waste += n * (capacity - sum(s * k for s, k in filling))
            trail.append((branches, big, filling, n))
            branches = None
            continue
        if not trail:
            break
        branches, _, filling, n = trail.pop()
        take(filling, n, -1)
        waste -= n * (capacity - sum(s * k for s, k in filling))
    return best, nodes, cut


def pack(counts: dict[int, int], capacity: int, nodes: int = NODES) -> Plan:
    """Fillings that hold every piece of the histogram in as few bins as found."""
    counts = {s: n for s, n in counts.items() if n}
    plan = best_fit(counts, capacity)
    least, width, steps, cut = lower_bound(counts, capacity), WIDTH, STEPS, True
    while cut and nodes > 0 and sum(n for _, n in plan) > least:
        plan, nodes, cut = complete(counts, capacity, plan, least, nodes, width, steps)
        width, steps = 4 * width, 4 * steps
    return plan

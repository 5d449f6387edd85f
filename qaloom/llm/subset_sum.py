"""Bounded subset sums over sizes with multiplicities, by bitsets."""

from __future__ import annotations

import math

#: The bitset tried first. Of a target beyond it all but half of this is first taken from every size in proportion.
MAX_BITS = 1 << 17
#: Bits kept over all sizes at most, a quarter of a gigabyte: how far bitsets may be widened.
MAX_CELLS = 1 << 31


def _prefill(counts: dict[int, int], target: int, bits: int) -> tuple[dict[int, int], int]:
    """Of each size the same part, what rounding leaves over going to the next smaller size."""
    if target <= bits:
        return {}, target
    total = sum(s * n for s, n in counts.items())
    part, carry, taken = (target - bits // 2) / total, 0.0, {}
    for size in sorted(counts, reverse=True):
        wanted = counts[size] * part * size + carry
        k = max(0, min(counts[size], int(wanted // size)))
        carry = wanted - k * size
        if k:
            taken[size] = k
    return taken, target - sum(s * k for s, k in taken.items())


def closest_subset(counts: dict[int, int], target: int, at_most: bool = False, max_bits: int = MAX_BITS) -> dict[int, int]:
    """How many items of each size to take so that their total is closest to `target` (below it on a tie).

    `counts` has the number of items of each positive size. With `at_most` no total over the target counts. Of a target
    over half of all, the items left out are chosen instead, so that a target near to nothing or to all is small.

    Every total is a multiple of the sizes' greatest common divisor: a total as near as such a multiple can be is the
    closest there is. A choice whose smaller part is up to `max_bits` is exact anyway. Of a larger one most is first taken
    from all sizes in proportion; if its total isn't proved to be closest, the bitset is widened eightfold and the choice
    made again, up to the exact one or to MAX_CELLS. `residual` tells what is left. Sizes of 0 and less are never taken;
    nothing to choose from, or a target of 0 or less, gives an empty choice.
    """
    counts = {s: n for s, n in counts.items() if s > 0 and n > 0}
    if target <= 0 or not counts:
        return {}
    total = sum(s * n for s, n in counts.items())
    if total <= target:
        return dict(counts)
    small, bits, best, miss = min(target, total - target), max_bits, {}, None
    while True:
        if target * 2 <= total:
            out = _closest(counts, target, True, not at_most, True, bits)
        else:
            rest = _closest(counts, total - target, not at_most, True, False, bits)
            out = {s: n - rest.get(s, 0) for s, n in counts.items() if n > rest.get(s, 0)}
        got = sum(s * n for s, n in out.items())
        if miss is None or (abs(got - target), got) < miss:
            best, miss = out, (abs(got - target), got)
        if small <= bits or miss[0] <= residual_bound(counts, target, at_most) or bits * 8 * len(counts) > MAX_CELLS:
            return best
        bits *= 8


def residual_bound(counts: dict[int, int], target: int, at_most: bool = False) -> int:
    """How far from `target` the closest total is at least: sums of sizes are multiples of their greatest common divisor."""
    g = math.gcd(*counts) if counts else 1
    over = target % g
    return over if at_most else min(over, g - over)


def residual(counts: dict[int, int], chosen: dict[int, int], target: int) -> int:
    """What a choice lacks to `target`; less than 0 if it is over it."""
    return target - sum(s * n for s, n in chosen.items())


def _closest(counts: dict[int, int], target: int, below: bool, above: bool, prefer_below: bool, max_bits: int) -> dict[int, int]:
    """The choice closest to `target` with a total `below` it, `above` it, or either, which may be equal to it.

    Reachable totals are a bitset; one size with a multiplicity is added by shifts of 1, 2, 4, ... and a rest, so the
    cost is distinct sizes * log(multiplicity) * bits / 64. The bitset before each size is kept and the choice is read
    off backwards.
    """
    taken, rest = _prefill(counts, target, max_bits)
    left = {s: n - taken.get(s, 0) for s, n in counts.items() if n > taken.get(s, 0)}
    top = rest if not above else 2 * rest if below else rest + max(left)
    mask = (1 << (top + 1)) - 1
    reach, before = 1, []
    for size in sorted(s for s in left if s <= top):
        before.append((size, left[size], reach))
        n, step = min(left[size], top // size), 1
        while n > 0:
            k = min(step, n)
            reach = (reach | (reach << (k * size))) & mask
            n -= k
            step *= 2
    low = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    best = low
    high = reach >> rest
    if above and high:
        over = rest + ((high & -high).bit_length() - 1)
        if not below or over - rest < rest - low or (over - rest == rest - low and not prefer_below):
            best = over
    for size, n, earlier in reversed(before):
        k = 0
        while not (earlier >> best) & 1:
            best -= size
            k += 1
            if k > n or best < 0:
                raise AssertionError("a reachable total has no way back")
        if k:
            taken[size] = taken.get(size, 0) + k
    return taken

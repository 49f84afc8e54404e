"""Dominance where three or more pieces fit beside one."""

import random
from collections import Counter
from functools import cache

from tideline.llm import packing


def least(items, capacity):
    @cache
    def go(left, rooms):
        if not left:
            return len(rooms)
        first, rest = left[0], left[1:]
        ways = [go(rest, tuple(sorted((*rooms[:k], r - first, *rooms[k + 1 :])))) for k, r in enumerate(rooms) if r >= first and (not k or rooms[k - 1] != r)]
        return min([*ways, go(rest, tuple(sorted((*rooms, capacity - first))))])

    return go(tuple(sorted(items, reverse=True)), ())


def costs_nothing(items, capacity):
    left = Counter(items)
    fixed = packing.dominated(left, capacity)
    rest = list(left.elements())
    assert Counter(items) == Counter(rest) + sum((Counter({s: sizes.count(s) * n for s in set(sizes)}) for sizes, n in fixed), Counter())
    assert all(sum(sizes) <= capacity for sizes, _ in fixed)
    assert sum(n for _, n in fixed) + (least(rest, capacity) if rest else 0) == least(items, capacity), (items, capacity, fixed)
    return max((len(sizes) for sizes, _ in fixed), default=0)


def test_three_small_pieces_beside_a_large_one():
    costs_nothing([60, 35, 33, 32, 13, 13, 13], 100)


def test_random_cases_cost_nothing():
    rng, largest = random.Random(9), Counter()
    for _ in range(800):
        capacity = rng.randint(8, 60)
        largest[costs_nothing([rng.randint(1, capacity) for _ in range(rng.randint(3, 8))], capacity)] += 1
    assert largest[3] > 20

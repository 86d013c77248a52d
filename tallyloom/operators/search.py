"""Searches over parameters: the driver holds a few candidates, Spark works each set of them out in one job."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable

Candidate = tuple[int, ...]


def random_candidates(space: list[list[int]], n: int, seed: int = 42, valid: Callable[[Candidate], bool] = lambda _: True) -> list[Candidate]:
    """Up to n different valid candidates, in the order drawn."""
    rng, found = random.Random(seed), {}
    for _ in range(20 * n):
        drawn = tuple(rng.choice(values) for values in space)
        if valid(drawn):
            found[drawn] = True
        if len(found) == n:
            break
    return list(found)


def genetic(evaluate: Callable[[Iterable[Candidate]], dict[Candidate, float]], space: list[list[int]], size: int = 8, generations: int = 6, seed: int = 42, mutation: float = 0.2, elite: int = 2, patience: int = 3, valid: Callable[[Candidate], bool] = lambda _: True) -> list[tuple[int, Candidate, float]]:
    """The best candidate and its value after each generation.

    Parents win tournaments of three, children take each value from either parent, some values are drawn anew, the elite
    stays, and the search ends after as many generations without gain as patience says.  Candidates are valued once.
    """
    rng, known, history, idle = random.Random(seed), {}, [], 0
    people = random_candidates(space, size, seed, valid)
    for generation in range(generations):
        new = [p for p in dict.fromkeys(people) if p not in known]
        if new:
            known |= evaluate(new)
        order = sorted(dict.fromkeys(people), key=lambda p: (-known[p], p))
        idle = idle + 1 if history and known[order[0]] <= history[-1][2] else 0
        history.append((generation, order[0], known[order[0]]))
        if idle == patience:
            break
        following = order[:elite]
        tries = 0
        while len(following) < size and tries < 50 * size:
            tries += 1
            parents = [min(rng.choices(people, k=3), key=lambda p: (-known[p], p)) for _ in range(2)]
            child = tuple(rng.choice(values) if rng.random() < mutation else parents[rng.random() < 0.5][i] for i, values in enumerate(space))
            if valid(child):
                following.append(child)
        people = following
    return history

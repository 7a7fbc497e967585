"""Chains of lines against a walk from end to end."""

import random

from trailspark.operators.stitch import stitched


def by_force(lines):
    """line -> (chain, place, reversed), by walking from both directions of every line."""
    ends = {}
    for line, g, head, tail in sorted(lines):
        for side, at in ((0, head), (1, tail)):
            if g is not None and at is not None:
                ends.setdefault((g, at), []).append((line, side))
    partner = {}
    for met in ends.values():
        for a, b in zip(met[::2], met[1::2]):
            partner[a], partner[b] = b, a
    step = lambda p: (lambda o: None if o is None else o[0] * 2 + o[1])(partner.get((p // 2, 1 - p % 2)))
    out = {}
    passages = [line * 2 + d for line, *_ in lines for d in (0, 1)]
    following = {step(p) for p in passages}
    chains = []
    for p in passages:
        if p not in following:
            chain = [p]
            while (n := step(chain[-1])) is not None:
                chain.append(n)
            chains.append(chain)
    seen = {p for c in chains for p in c}
    for p in sorted(passages):
        if p not in seen:
            chain = [p]
            while (n := step(chain[-1])) != p:
                chain.append(n)
            seen.update(chain)
            chains.append(chain)
    for c in chains:
        if min(c) % 2 == 0:
            for k, p in enumerate(c):
                out[p // 2] = (min(c) // 2, k, p % 2 == 1)
    return out


def test_chains_equal_a_walk(spark):
    rng = random.Random(19)
    lines = []
    for g in ("a", "b", None):
        for places in (4, 12, 60):
            lines += [(len(lines) + k, g, *(None if rng.random() < 0.03 else f"{g}{places}.{rng.randrange(places)}" for _ in range(2))) for k in range(places)]
    ring = [(1000 + k, "r", f"r{k}", f"r{(k + 1) % 37}") for k in range(37)]
    ring = [(i, g, b, a) if i % 3 == 0 else (i, g, a, b) for i, g, a, b in ring]
    row = [(2000 + (k * 7) % 50, "l", f"l{k}", f"l{k + 1}") for k in range(50)]
    lines += [*ring, *row, (3000, "s", "s", "s"), (3001, "s", "s", "t")]
    rng.shuffle(lines)
    df = spark.createDataFrame(lines, "line long, name string, head string, tail string")
    got = {r["line"]: (r["chain"], r["place"], r["reversed"]) for r in stitched(df, ["name"]).collect()}
    assert got == by_force(lines) and len(got) == len(lines)
    assert {c for c, *_ in (got[i] for i, *_ in ring)} == {1000} and sorted(got[i][1] for i, *_ in row) == list(range(50))
    assert got[3000] == (3000, 0, False) and got[3001] == (3001, 0, False)


def test_no_lines(spark):
    assert stitched(spark.createDataFrame([], "line long, name string, head string, tail string"), ["name"]).count() == 0

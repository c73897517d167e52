"""Rounds over a frontier against a plain loop."""

import random
from collections import defaultdict

import pytest

from orrery.operators import frontier

EDGES = "source long, target long, score int, pos int"


def walked(starts, strategies, accepted):
    visited, rounds, nth = {}, [], 0
    for org, key in starts:
        if org is not None and key is not None:
            visited[org, key] = (None, "start", 0)
    for name, edges, n_rounds, budget in strategies:
        by_source = defaultdict(list)
        for s, t, score, pos in edges:
            by_source[s].append((t, score, pos))
        current = set(visited)
        for _ in range(n_rounds):
            nth += 1
            settled = {o for o, k in visited if k in accepted}
            best = defaultdict(dict)
            for org, key in current:
                for t, score, pos in by_source[key] if org not in settled else []:
                    if t is not None and (org, t) not in visited:
                        step = (-score, pos, key)
                        best[org][t] = min(step, best[org].get(t, step))
            current = set()
            for org, found in best.items():
                for t, step in sorted(found.items(), key=lambda x: (x[1][0], x[1][1], x[0]))[:budget]:
                    visited[org, t] = (step[2], name, nth)
                    current.add((org, t))
            if not current:
                break
            rounds.append((name, nth, len(current), sum(k in accepted for _, k in current)))
    return visited, rounds


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_equal_a_plain_loop(spark, seed):
    rnd = random.Random(seed)
    graph = lambda n: [(rnd.randrange(80), rnd.choice([None, *range(80)]) if rnd.random() < 0.1 else rnd.randrange(80), rnd.randint(0, 3), rnd.randint(0, 2)) for _ in range(n)]
    strategies = [("links", graph(60) + [(1, 2, 3, 0)] * 3, 3, 2), ("none", [], 4, 9), ("more", graph(90), 5, 1)]
    starts = [(f"o{i}", rnd.randrange(80)) for i in range(40)] * 2 + [(None, 3), ("lost", None)]
    accepted = set(rnd.sample(range(80), 9))
    want, rounds = walked(starts, strategies, accepted)
    made = [frontier.Strategy(n, spark.createDataFrame(e, EDGES), r, b) for n, e, r, b in strategies]
    good = spark.createDataFrame([(k,) for k in [*accepted, *accepted, None]], "key long")
    visited, log = frontier.explored(spark.createDataFrame(starts, "org string, key long"), made, good)
    got = {(r.org, r.key): (r.source, r.strategy, r.round) for r in visited.collect()}
    assert got == want and [x for x in log if x[0] != "start"] == rounds
    assert {r.accepted for r in visited.collect() if r.key in accepted} <= {True} and visited.count() == len(want)
    ends = {r.org: (r.round, r.key, r.n_visited) for r in frontier.found(visited).collect()}
    for org in {o for o, _ in want}:
        hits = [(v[2], k) for (o, k), v in want.items() if o == org and k in accepted]
        assert ends[org] == (*(min(hits) if hits else (None, None)), sum(o == org for o, _ in want))
    assert any(r[0] == "more" for r in rounds) and not any(r[0] == "none" for r in rounds)


def test_nothing_to_start_from(spark):
    none = spark.createDataFrame([], "org string, key long")
    visited, log = frontier.explored(none, [frontier.Strategy("s", spark.createDataFrame([(1, 2, 1, 1)], EDGES), 2, 2)], none.select("key"))
    assert visited.count() == 0 and log == [] and frontier.found(visited).count() == 0

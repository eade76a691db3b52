import random

import pytest

from kinweave.llm import mixing


def quota_targets(sizes, weights, share=1.5, limit=2):
    """The targets by plain rounds: what is above its limit is cut, and the excess shared out anew."""
    target = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), [k for k in range(len(sizes)) if sizes[k] > 0]
    while open_:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] / total > limit * sizes[k]]
        if not full:
            for k in open_:
                target[k] = left * weights[k] / total
            break
        for k in full:
            target[k] = float(limit * sizes[k])
        left -= sum(target[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return target


def test_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 50)
    rng = random.Random(1)
    for sizes in ([100, 100, 100], [10, 0], [], [0, 0], [7], [rng.choice([0, 1, 5, 2000, 10**6]) * rng.randint(0, 9) for _ in range(400)]):
        names = sorted((f"s{rng.random()}\U0001f600é"[rng.randint(0, 3) :] + str(k) for k in range(len(sizes))), key=str)
        if len(names) > 5:
            names = sorted(names[:-1], key=lambda s: s.encode()) + [None]
        got = mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size bigint").repartition(3)).collect()
        got = sorted(got, key=lambda r: r["rank"])
        assert [r["source"] for r in got] == names and [r["rank"] for r in got] == list(range(len(names)))
        want = quota_targets(sizes, [[5, 2, 1][k % 3] for k in range(len(sizes))])
        assert [r["target"] for r in got] == pytest.approx(want)


def cheapest(capacity, members, quota, repeats):
    """Largest flow and its least cost, by linear programming over whole tokens: a plain search over residual cycles."""
    arcs, n = [], 2 + len(capacity) + len(quota)

    def arc(a, b, cap, cost):
        arcs.append([a, b, cap, cost])
        arcs.append([b, a, 0, -cost])

    for p, (c, m) in enumerate(zip(capacity, members, strict=True)):
        for r in range(repeats):
            arc(0, 2 + p, c, r)
        for s in m:
            arc(2 + p, 2 + len(capacity) + s, 10**9, 0)
    for s, q in enumerate(quota):
        arc(2 + len(capacity) + s, 1, q, 0)
    total = cost = 0
    while True:
        far, via = [0] + [10**9] * (n - 1), [None] * n
        for _ in range(n):
            for k, (a, b, cap, c) in enumerate(arcs):
                if cap and far[a] + c < far[b]:
                    far[b], via[b] = far[a] + c, k
        if far[1] == 10**9:
            return total, cost
        at, path = 1, []
        while at:
            path.append(via[at])
            at = arcs[via[at]][0]
        x = min(arcs[k][2] for k in path)
        for k in path:
            arcs[k][2] -= x
            arcs[k ^ 1][2] += x
        total, cost = total + x, cost + x * far[1]


def test_flow_is_cheapest():
    rng = random.Random(2)
    for _ in range(150):
        n, m = rng.randint(1, 7), rng.randint(1, 5)
        members = [sorted(rng.sample(range(m), rng.randint(1, min(m, 3)))) for _ in range(n)]
        capacity, quota = [rng.randint(0, 40) for _ in range(n)], [rng.randint(0, 90) for _ in range(m)]
        flow = mixing.route(capacity, members, quota, 2)
        used = [round(sum(f.values())) for f in flow]
        assert all(x >= 0 for f in flow for x in f.values()) and all(u <= 2 * c for u, c in zip(used, capacity, strict=True))
        assert all(round(sum(f.get(s, 0) for f in flow)) <= q for s, q in enumerate(quota))
        cost = sum(max(0, u - c) for u, c in zip(used, capacity, strict=True))
        assert (sum(used), cost) == cheapest(capacity, members, quota, 2)


def test_flow_of_many_patterns():
    n = 200_000
    flow = mixing.route([10] * n, [[k] for k in range(n)], [15.0] * n, 2)
    assert all(sum(f.values()) == 15.0 for f in flow)


def test_flow_prefers_new_tokens():
    # pattern {0,1} can serve either source; each has 100 of its own
    flow = mixing.route([100, 100, 100], [[0], [1], [0, 1]], [150, 150], 2)
    assert [round(sum(f.values())) for f in flow] == [100, 100, 100]
    assert round(flow[0][0] + flow[2][0]) == 150 and round(flow[1][1] + flow[2][1]) == 150


def test_flow_gives_back():
    # source 0 can only use the shared pattern, source 1 has its own as well
    flow = mixing.route([100, 100], [[0, 1], [1]], [200, 100], 2)
    assert round(flow[0][0]) == 200 and round(flow[1][1]) == 100 and round(flow[0][1]) == 0


@pytest.fixture
def mixed(docs):
    rows = [(i, "w " * (1 + i % 37), "en", None if i % 7 == 3 else "abc"[i % 3]) for i in range(900)]
    rows += [(900, None, "en", "a"), (901, "", "en", None), (902, " \t\n", "en", "z"), (903, "w " * 3000, "en", "b")]
    return docs(rows)


def test_mix(mixed):
    out = mixing.mix(mixed).collect()
    assert len(out) == 904
    by = {}
    for r in out:
        assert 0 <= r["copies"] <= 2 and (r["size"] > 0 or r["copies"] == 0)
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    assert order == ["a", "b", "c", "z", None]
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    for s, size, target in zip(order, sizes, quota_targets(sizes, [5, 2, 1, 5, 2]), strict=True):
        assert by[s][0]["source_size"] == size and by[s][0]["target"] == pytest.approx(target)
        assert sum(r["copies"] * r["size"] for r in by[s]) == pytest.approx(target, abs=max(1, 0.001 * target))
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(mixed.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in out}


def test_end_of_a_quota_is_filled(docs):
    # the long document can't be taken in part: short ones fill what it leaves
    rows = [(i, "w " * (5000 if i == 7 else 90 + i), "en", "a") for i in range(60)] + [(100 + i, "w " * 50, "en", "b") for i in range(400)]
    out = mixing.mix(docs(rows)).collect()
    for s in "ab":
        own = [r for r in out if r["source"] == s]
        assert sum(r["copies"] * r["size"] for r in own) == pytest.approx(own[0]["target"], rel=0.01)


def test_rows_under_one_id(docs):
    rows = [(i % 5, f"x{i} " + "w " * (i % 30), "en", "abc"[i % 3]) for i in range(300)] + [(None, f"y{i} w", "en", "a") for i in range(5)] + [(0, "x0 ", "en", "a")] * 3
    out = mixing.mix(docs(rows), carry=("text",)).collect()
    assert len(out) == len(rows) and sorted(str(r["text"]) for r in out) == sorted(str(r[1]) for r in rows)
    for r in out:
        assert r["size"] == len(r["text"].split()) and 0 <= r["copies"] <= 2
    assert len({r["copies"] for r in out if r["doc_id"] == 0 and r["text"] == "x0 "}) == 1
    for s in "abc":
        own = [r for r in out if r["source"] == s]
        assert sum(r["copies"] * r["size"] for r in own) == pytest.approx(own[0]["target"], rel=0.01)


def test_overlapping_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUTED", 3)
    rows = [(i, "w " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(100)] + [(100 + i, "w " * 7, ["d", "c", "d"]) for i in range(50)] + [(200, "w w", None), (201, "w w", []), (202, "w", [None, "e"])]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert len(out) == 153 and max(r["copies"] for r in out) <= 2
    by = {r["doc_id"]: r for r in out}
    assert by[100]["source"] == "c" and by[200]["source"] is None and by[200]["source_size"] == by[202]["size"] + 4


def test_many_sources(docs):
    out = mixing.mix(docs([(i, "w " * (1 + i % 50), "en", f"site{i}") for i in range(3000)])).collect()
    assert len(out) == 3000 and max(r["copies"] for r in out) == 2
    assert len({r["source"] for r in out}) == 3000


def test_empty(docs):
    assert mixing.mix(docs([])).count() == 0

"""Groups by shared links and rows for many viewers, against plain Python."""

import random
from collections import defaultdict

from scholia.operators import catalog, graph


def _merged(links, rounds=None):
    label = {n: n for a, b, _ in links for n in (a, b)}
    done = 0
    while rounds is None or done < rounds:
        between, degree = defaultdict(int), defaultdict(int)
        for a, b, w in links:
            for x, y in ((label[a], label[b]), (label[b], label[a])):
                degree[x] += w
                between[x, y] += w
        m2 = sum(degree.values())
        named = {}
        for x in degree:
            gains = [(degree[x] * degree[y] - m2 * w, y) for (z, y), w in between.items() if z == x and y != x]
            gains = [g for g in gains if g[0] < 0]
            if gains:
                named[x] = min(gains)[1]
        root = {x: min(y, named[y]) for x, y in named.items() if named[named[y]] == y}
        if all(x == y for x, y in root.items()):
            break
        label = {n: root.get(c, c) for n, c in label.items()}
        done += 1
    return label


def _groups(spark, links, rounds=None):
    df = spark.createDataFrame(links, "a string, b string, w long")
    return {r.node: r.component for r in graph.modularity_groups(df, rounds).collect()}


def test_modularity_groups(spark):
    rng = random.Random(4)
    pairs = {}
    for i in range(24):  # four dense groups, a few links across
        for j in range(i):
            if rng.random() < (0.7 if i % 4 == j % 4 else 0.05):
                pairs[f"n{j:02d}", f"n{i:02d}"] = rng.randint(1, 5)
    pairs |= {("hub", f"leaf{i}"): 1 for i in range(30)}
    links = [(*sorted(p), w) for p, w in pairs.items()]
    got = _groups(spark, links)
    assert got == _merged(links)
    assert len({got[f"leaf{i}"] for i in range(30)}) == 1
    assert _groups(spark, links, 1) == _merged(links, 1) != got


def test_modularity_groups_of_ties_and_nothing(spark):
    ring = [(*sorted((f"r{i}", f"r{(i + 1) % 7}")), 1) for i in range(7)]
    assert _groups(spark, ring) == _merged(ring)
    assert _groups(spark, []) == {}
    big = [("a", "b", 10**17), ("b", "c", 1), ("c", "d", 10**17)]
    assert _groups(spark, big) == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_rows_of_every_viewer(spark):
    rows = [(1, "ready", 7), (2, "failed", 7), (3, "failed", None), (4, None, 8), (5, "processing", None), (6, "failed", 9)]
    roles = [(8, "student"), (8, "admin"), (8, "admin"), (7, "student")]
    materials = spark.createDataFrame(rows, "id long, status string, uploaded_by long")
    role = spark.createDataFrame(roles, "user_id long, role string")
    viewers = spark.createDataFrame([(7,), (7,), (8,), (10,), (None,)], "viewer long")
    got = sorted(catalog.visible_totals(viewers, materials, role).collect(), key=str)
    want = []
    for v in (7, 7, 8, 10, None):
        seen = [r.id for r in catalog.visible_rows(materials, v, role).collect()]
        want.append((v, len(seen), sum(seen)))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(r[0]) if r[0] is not None else "x")
    kinds = {r.id: r.audience for r in catalog.row_audiences(materials).collect()}
    assert kinds == {1: "all", 2: "owner", 3: "admin", 4: "owner", 5: "all", 6: "owner"}
    nobody = catalog.visible_totals(viewers, materials.limit(0), role.limit(0)).collect()
    assert [(r.n_rows, r.id_sum) for r in nobody] == [(0, 0)] * 5


def test_moves_give_every_viewers_order(spark):
    programmes = spark.createDataFrame([(i, f"name{i % 3}") for i in range(9)], "code long, name string")
    profiles = spark.createDataFrame([(1, 4), (2, 0), (3, None), (4, 99)], "id long, programme_code long")
    base = [r.code for r in programmes.orderBy("name", "code").collect()]
    for r in catalog.own_first_moves(programmes, profiles).collect():
        order = list(base)
        if r.own is not None:
            order.insert(0, order.pop(r.moved_from - 1))
            assert order[0] == r.own
        assert order == [p.code for p in catalog.own_first_order(programmes, profiles, r.id).collect()]

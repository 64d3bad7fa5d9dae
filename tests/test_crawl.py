import random

from siteweave.operators import crawl


def model(links, root, budget, verdicts):
    """Plain best-first exploration on linked nodes."""
    parent, score, explored, order, queue, n, used, products = {root: None}, {root: 0.0}, set(), [], [(0.0, 0, root)], 1, 0, []

    def mean(u):
        s = []
        while u is not None:
            s += [score[u]] if score[u] > 0 else []
            u = parent[u]
        return sum(s) / len(s) if s else 0.0

    while queue and used < budget:
        queue.sort(key=lambda x: (-x[0], x[1]))
        _, _, u = queue.pop(0)
        if u in explored:
            continue
        explored.add(u)
        order.append(u)
        if score[u] >= 8 and u in verdicts:
            products.append(u)
            continue
        used += 1
        for v, s, name in links.get(u, ()):
            if v in score:
                continue
            parent[v], score[v] = u, s
            if s < 1 or s >= 9:
                explored.add(v)
                if s >= 9 and name:
                    products.append(v)
            else:
                queue.append((mean(v), n, v))
                n += 1
    return order, set(products), set(score), explored


def test_best_first_against_a_model():
    for seed in range(60):
        r = random.Random(seed)
        names = [f"u{i}" for i in range(40)]
        links = {u: [(r.choice(names), r.choice([0.5, 2, 5, 5, 7.5, 8.5, 9.5]), r.choice([None, "p"])) for _ in range(r.randint(0, 6))] for u in ["root", *names]}
        verdicts = {u: "v" for u in names if r.random() < 0.3}
        budget = r.randint(1, 30)
        rows = crawl.explore(links, "root", budget, verdicts)
        order, products, known, explored = model(links, "root", budget, verdicts)
        popped = [x[0] for x in sorted((x for x in rows if x[6] is not None), key=lambda x: x[6])]
        assert popped == order
        assert {x[0] for x in rows} == known
        assert {x[0] for x in rows if x[7]} == explored
        assert {x[0] for x in rows if x[9]} == products


def test_golden_cases():
    rows = {x[0]: x for x in crawl.explore({"r": [("a", 6.0, None)], "a": [("b", 4.0, None), ("n", 9.5, None)]}, "r", 10)}
    assert rows["b"][4] == 5.0  # the root's score doesn't count
    assert rows["n"][7] and rows["n"][9] is None  # explored, not a product without a name
    ties = crawl.explore({"r": [("x", 5.0, None), ("y", 5.0, None)]}, "r", 10)
    assert [x[0] for x in sorted(ties, key=lambda x: x[6])] == ["r", "x", "y"]
    verified = {x[0]: x for x in crawl.explore({"r": [("p", 8.5, None)], "p": [("q", 5.0, None)]}, "r", 2, {"p": "N"})}
    assert verified["p"][9] == "verify" and "q" not in verified


def test_bfs_and_waves(spark):
    edges = spark.createDataFrame([("s", "r", "a", 1, 5000, None), ("s", "r", "b", 0, 6000, None), ("s", "a", "c", 0, 4000, None), ("s", "b", "c", 0, 4000, None), ("s", "c", "r", 0, 5000, None)], "site string, parent_url string, url string, pos int, milli int, product_name string")
    roots = spark.createDataFrame([("s", "r")], "site string, url string")
    got = {r["url"]: (r["level"], r["rank"], r["parent_url"]) for r in crawl.bfs(edges, roots).collect()}
    assert got == {"r": (0, 1, None), "b": (1, 1, "r"), "a": (1, 2, "r"), "c": (2, 1, "b")}
    waves = {r["url"]: r["wave"] for r in crawl.waves(edges, roots, 1, 3).collect()}
    assert waves["r"] == 0 and waves["b"] == 1 and set(waves) == {"r", "a", "b", "c"}


def test_plans(spark):
    rows = spark.createDataFrame([("s", "r", "a", 1)], "site string, parent_url string, url string, pos int")
    known = spark.createDataFrame([("s", "a")], "site string, url string")
    plan = rows.join(known, ["site", "url"], "left_anti")._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "CartesianProduct" not in plan

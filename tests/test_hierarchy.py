import random

from helpers import comments, rows

from spanloom.operators.hierarchy import comment_forest, descendants


def brute(parents):
    out = {}
    for n in parents:
        seen, at, path = {n}, n, []
        while True:
            ref = parents[at]
            if ref is None:
                out[n] = (f"t1_{at}", len(path), path)
                break
            if not ref.startswith("t1_") or ref[3:] not in parents:
                out[n] = (ref, len(path) + 1, [*path, ref])
                break
            at = ref[3:]
            if at in seen:
                out[n] = ("cycle", -1, None)
                break
            seen.add(at)
            path.append(at)
    return out


def test_random_forest_against_brute_force(spark):
    rng = random.Random(3)
    parents = {}
    for i in range(300):
        k = rng.random()
        n = f"n{i}"
        parents[n] = None if k < 0.03 else f"t3_p{i % 5}" if k < 0.1 else f"t1_gone{i}" if k < 0.12 else f"t1_n{rng.randrange(max(1, i))}"
    for i in range(200):  # a long chain, rings of several sizes with tails, a self loop
        parents[f"c{i}"] = f"t1_c{i - 1}" if i else "t3_chain"
    for size in (1, 2, 7, 40):
        for i in range(size):
            parents[f"r{size}_{i}"] = f"t1_r{size}_{(i + 1) % size}"
        parents[f"tail{size}"] = f"t1_r{size}_0"
        parents[f"tail{size}b"] = f"t1_tail{size}"
    want = brute(parents)
    df = comments(spark, [(n, "t3_x", f" {p} " if p and hash(n) % 3 == 0 else p) for n, p in parents.items()])
    for gap in (3, 1_000_000):
        got = {r["id"]: (r["root"], r["depth"], r["path"]) for r in comment_forest(df, gap=gap, paths=True).collect()}
        assert got == want
    plain = {r["id"]: (r["root"], r["depth"]) for r in comment_forest(df).collect()}
    assert plain == {n: v[:2] for n, v in want.items()}


def test_descendants_and_empty(spark):
    f = comment_forest(comments(spark, [("a", "p", None), ("b", "p", "t1_a"), ("c", "p", "t1_b"), ("d", "p", "t3_p")]), paths=True)
    assert rows(descendants(f), "id", "descendant", "distance") == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    assert rows(comment_forest(comments(spark, []))) == []
    assert rows(comment_forest(comments(spark, [(None, None, None)]))) == []

import pytest
from helpers import comments, posts, rows

from spanloom.operators import orphans
from spanloom.operators.orphans import forum_orphans, orphan_cascade
from spanloom.plans.scratch import Scratch


def test_states_levels_and_dirt(spark):
    p = posts(spark, [("p1", "hello", 10), ("p2", "[removed]", 10), ("p3", None, 500), ("p4", "", 1)])
    c = comments(
        spark,
        [
            ("a", "t3_p1", "t3_p1", "u", 1, "hi", 100),
            ("b", " p9 ", "t1_a", "u", 1, "hi", 100),  # thread missing
            ("c", "t3_p2", "t1_b", "u", 1, "hi", 100),  # thread dead, below b
            ("d", "t3_p3", "t1_c", "u", 1, "hi", 100),  # thread captured later
            ("e", "t3_p4", "t1_d", "u", 1, "[deleted]", 100),
            ("f", None, "t1_e", "u", 1, "hi", 100),  # parent dead
            ("g", "", "  ", "u", 1, "hi", 100),  # no references
            ("h", "t3_p1", "t1_zz", "u", 1, "hi", 100),  # parent missing
            ("i", "t3_p1", "t1_h", "u", 1, "hi", 100),
            ("i", "t3_p1", "t1_h", "u", 1, "hi", 100),  # exact repeat
            ("i", "t3_p1", None, "u", 1, "hi", 50),  # an older capture
            ("r1", "t3_p1", "t1_r2", "u", 1, "hi", 100),
            ("r2", "t3_p1", "t1_r1", "u", 1, "hi", 100),  # a ring
            (None, "t3_p9", "t1_zz", "u", 1, "hi", 100),
        ],
    )
    rep = forum_orphans(c, p)
    assert rows(rep.direct, "id", "ref_field", "state") == [
        ("b", "link_id", "missing"), ("c", "link_id", "deleted"), ("d", "link_id", "late"), ("f", "parent_id", "deleted"), ("h", "parent_id", "missing"), ("i", "parent_id", "late"),
    ]
    # d hangs below c, e below d, i below h; c is broken itself
    assert rows(rep.inherited, "id", "level", "cause") == [("d", 1, "deleted"), ("e", 2, "deleted"), ("i", 1, "missing")]
    by = {(r["ref_field"], r["cause"]): (r["n_direct"], r["n_inherited"]) for r in rep.by_period().collect()}
    assert by["link_id", "missing"] == (1, 0) and by["parent_id", "missing"] == (1, 1) and by["parent_id", "deleted"] == (1, 2) and by["parent_id", "late"] == (1, 0)


def test_empty_tables(spark):
    rep = forum_orphans(comments(spark, []), posts(spark, []))
    assert rows(rep.all()) == [] and rows(rep.by_period()) == []


REFS = "node string, id string, rec_table string, ref_field string, target string, month string, first_seen bigint"
ENTITIES = "e_node string, e_dead boolean, e_first bigint, e_refers boolean"


def cascade(spark, nodes, links, dead=()):
    """Orphans of records ``table:key`` with any number of references each."""
    e = spark.createDataFrame([(n, n in dead, 1, True) for n in nodes], ENTITIES)
    r = spark.createDataFrame([(a, a, a.split(":")[0], f"f{i}", b, None, 1) for i, (a, b) in enumerate(links)], REFS)
    rep = orphan_cascade(e, r, Scratch(spark, "t"))
    return rows(rep.direct, "node", "target", "state"), rows(rep.inherited, "node", "target", "level", "cause")


@pytest.mark.parametrize("rows_per_bucket", [10**9, 0])
def test_three_tables_several_fields_and_rings(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(orphans, "BUCKET_ROWS", rows_per_bucket)
    nodes = ["a:1", "a:2", "b:1", "b:2", "b:3", "c:1", "c:2", "c:3", "c:4"]
    links = [
        ("b:1", "a:1"), ("b:2", "a:9"), ("b:3", "a:2"),  # a:9 is missing, a:2 dead
        ("c:1", "b:1"), ("c:1", "b:2"), ("c:1", "c:2"), ("c:2", "c:3"), ("c:3", "c:1"),  # a ring that hangs from b:2
        ("c:4", "c:1"), ("c:4", "b:3"),
    ]
    direct, inherited = cascade(spark, nodes, links, dead={"a:2"})
    assert direct == [("b:2", "a:9", "missing"), ("b:3", "a:2", "deleted")]
    assert inherited == [("c:1", "b:2", 1, "missing"), ("c:1", "c:2", 1, "missing"), ("c:2", "c:3", 3, "missing"), ("c:3", "c:1", 2, "missing"), ("c:4", "b:3", 1, "deleted"), ("c:4", "c:1", 1, "deleted")]


@pytest.mark.parametrize("rows_per_bucket", [10**9, 0])
def test_deep_chains_and_a_dominant_target(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(orphans, "BUCKET_ROWS", rows_per_bucket)
    chain = [f"c:{i}" for i in range(12)]
    links = [(chain[0], "c:gone")] + list(zip(chain[1:], chain)) + [(f"c:l{i}", "c:5") for i in range(200)] + [(f"c:s{i}", f"c:t{i}") for i in range(50)]
    nodes = [*chain, *[f"c:l{i}" for i in range(200)], *[f"c:s{i}" for i in range(50)], *[f"c:t{i}" for i in range(50)]]
    direct, inherited = cascade(spark, nodes, links)
    assert direct == [("c:0", "c:gone", "missing")]
    assert {(n, lv) for n, _, lv, _ in inherited} == {(c, i) for i, c in enumerate(chain) if i} | {(f"c:l{i}", 6) for i in range(200)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("spanloom_edges")]

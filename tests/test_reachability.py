"""Results that must not depend on how deep a graph is."""

from sparkpact.operators import coverage as C


def test_reachability_of_a_long_chain(spark):
    edges = [(f"n{k}", f"n{k + 1}") for k in range(70)] + [("n70", "n0"), ("n3", None), ("x", "n69")]
    reach = C.reachability(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("a", "n0"), ("b", "x")], "operation string, node string"))
    got = sorted(((r.operation, r.node) for r in reach.collect()), key=repr)
    nodes = [*(f"n{k}" for k in range(71)), None]
    assert got == sorted([*(("a", n) for n in nodes), ("b", "x"), *(("b", n) for n in nodes)], key=repr)
    assert C.reused(reach).where("node is not null").count() == 71

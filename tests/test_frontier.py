"""Breadth first search over a chain deeper than any fixed number of rounds."""

from docloom.operators import graph


def test_long_chain(spark):
    links = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(55)], "src string, dst string")
    got = {r.url: r.depth for r in graph.frontier(links, spark.createDataFrame([("p0",)], "url string")).collect()}
    assert got == {f"p{i}": i for i in range(56)}

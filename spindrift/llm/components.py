"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spindrift.session import written


def connected(links: DataFrame, name: str = "links") -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``, comparable ids); one root per component.

    Each round maps every node to the smallest of itself and its neighbours and replaces the
    links by those between the images, until none is left; the maps are then composed.
    Each join has a written table on both sides, so that a hub with many links can be
    split among tasks. Self links and repeated links do no harm; no links give no rows.
    """
    links = written(links.select("a", "b").filter("a <> b").distinct(), f"{name}-0")
    maps: list[DataFrame] = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        image = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        maps.append(written(image, f"{name}-map"))
        a = maps[-1].select(F.col("node").alias("a"), F.col("root").alias("x"))
        b = maps[-1].select(F.col("node").alias("b"), F.col("root").alias("y"))
        links = links.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        links = written(links.filter("a <> b").distinct(), f"{name}-{len(maps)}")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps.pop()
    while maps:
        later = out.select(F.col("node").alias("root"), F.col("root").alias("end"))
        out = written(
            maps.pop().join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root")), f"{name}-out"
        )
    return out

"""Connected components of a graph kept as a DataFrame of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut


def least_of(names: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """For each member the least name of its set, so that links made of it give a member one larger neighbour at most."""
    least = names.copy()
    np.minimum.at(least, roots, names)
    return least[roots]


def _least(links: DataFrame) -> DataFrame:
    """Distinct links (a, b), a above b, with m, the least b of each a. Repeats are dropped before the one shuffle, by a."""
    grouped = links.where("a <> b").groupBy("a").agg(F.collect_set("b").alias("bs"), F.min("b").alias("m"))
    return grouped.select("a", F.explode("bs").alias("b"), "m")


def star_roots(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root): each linked node but the roots, with the smallest node it reaches. links: a, b of one type.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Large-star moves a link (a, b) to (a, least of b).
    It joins on b, where a root may have most rows: both sides come from kept tables, so that Spark can split them.
    Small-star moves the b of one a to the least of them, which an a keeps in one row: links should lead to the least of
    what they connect (`least_of`), so that no a has many. It is done when each a has one b and no b is an a.
    """
    links = cut(_least(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    for _ in range(most_rounds):
        up = links.where("b = m").select(F.col("a").alias("_a"), F.col("m").alias("up"))
        moved = cut(links.join(up, F.col("b") == F.col("_a"), "left").select("a", "b", "m", "up"))
        if moved.where("b <> m or up is not null").isEmpty():
            return moved.select(F.col("a").alias("node"), F.col("b").alias("root"))
        large = _least(moved.select("a", F.coalesce("up", "b").alias("b")))
        pairs = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        links = cut(_least(large.select(F.inline(pairs))))
    raise RuntimeError(f"links still change after {most_rounds} rounds")

"""Graph operators on a pedigree: (id, sex, mother, father), a null parent is unknown.

All loops are level-synchronous: a round is one join and one aggregate over what is still open, stored between rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import counted, forget, stored


def edges(ped: DataFrame) -> DataFrame:
    """child, parent, role for every recorded parent, whether it has a row or not."""
    pair = F.array(F.struct(F.col("mother").alias("parent"), F.lit("mother").alias("role")), F.struct(F.col("father").alias("parent"), F.lit("father").alias("role")))
    return ped.select(F.col("id").alias("child"), F.explode(pair).alias("e")).select("child", "e.parent", "e.role").where("parent is not null")


def inner_edges(ped: DataFrame) -> DataFrame:
    """Edges whose parent has a row of its own."""
    return edges(ped).join(ped.select(F.col("id").alias("parent")), "parent", "left_semi").select("child", "parent", "role")


def structural_depth(ped: DataFrame, most: int | None = None) -> DataFrame:
    """id and depth: 0 without parents in the table, else one more than the deepest parent; null in and below cycles.

    A round is one job: the children of the last level count down their open links, and those without any are the next.
    """
    links = stored(inner_edges(ped).select("child", "parent"), "edges")
    waits = links.groupBy("child").agg(F.count("*").alias("open")).select(F.col("child").alias("id"), "open")
    now, seen = counted(ped.select("id").distinct().join(waits, "id", "left").select("id", F.coalesce("open", F.lit(0)).alias("open")), "depth", fresh=F.count_if(F.col("open") == 0))
    done = []
    level = 0
    while seen["fresh"]:
        fresh = now.where("open = 0")
        done.append(fresh.select("id", F.lit(level).alias("depth")))
        if level == most or seen["fresh"] == seen["n"]:
            break
        level += 1
        came = links.join(fresh.select(F.col("id").alias("parent")), "parent").groupBy("child").agg(F.count("*").alias("came"))
        rest = now.where("open > 0").join(came, F.col("id") == F.col("child"), "left").select("id", (F.col("open") - F.coalesce("came", F.lit(0))).alias("open"))
        now, seen = counted(rest, "depth", fresh=F.count_if(F.col("open") == 0))
    found = reduce(DataFrame.unionByName, done) if done else now.select("id", F.lit(0).alias("depth")).limit(0)
    return ped.select("id").distinct().join(found, "id", "left")


def closure(ped: DataFrame, most: int | None = None, keep_self: bool = True, of: DataFrame | None = None) -> DataFrame:
    """paths(id, anc, gen, n): the number of directed paths of each length from a person up to an ancestor.

    The pedigree must be acyclic; ``most`` bounds the length, ``of`` (id) the persons.  Each round extends the last generation only.
    """
    up = stored(inner_edges(ped).select("child", "parent"), "edges")
    level = (ped if of is None else of).select("id", F.col("id").alias("anc"), F.lit(0).alias("gen"), F.lit(1).cast("long").alias("n"))
    parts = [level] if keep_self else []
    gen = 0
    while most is None or gen < most:
        gen += 1
        level = level.join(up, F.col("anc") == F.col("child")).groupBy("id", F.col("parent").alias("a")).agg(F.sum("n").alias("n")).select("id", F.col("a").alias("anc"), F.lit(gen).alias("gen"), "n")
        level, seen = counted(level, "paths")
        if not seen["n"]:
            break
        parts.append(level)
    return reduce(DataFrame.unionByName, parts) if parts else level


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id and component (its least id) of each node; ``links`` is (a, b)."""
    roots = star_roots(links)
    return nodes.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("component"))


def star_roots(links: DataFrame) -> DataFrame:
    """node and root (the least node it reaches) for every node of ``links`` (a, b) but for the roots themselves.

    Alternating large-star and small-star steps: aggregates and joins on a node, so a hub is never gathered.  Rounds go on
    until nothing changes; of the tables only the last two are kept.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    now, before = counted(links.where("a != b").select(hi.alias("a"), lo.alias("b")).distinct(), "links", mark=mark)
    parts = max(4, -(-before["n"] // 50_000))  # a step has no more links than the one before: few links need few files
    while before["n"]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        then, after = counted(small.where("a != b").distinct().coalesce(parts), "links", mark=mark)
        forget(now)
        now = then
        if after == before:
            break
        before = after
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def pedigree_components(ped: DataFrame) -> DataFrame:
    return components(ped.select("id"), inner_edges(ped).select(F.col("child").alias("a"), F.col("parent").alias("b")))


def cycle_components(ped: DataFrame, depth: DataFrame | None = None) -> DataFrame:
    """id and cycle (least id) of the members of each strongly connected set of two or more; self-links don't count.

    Works on the rows without a depth only: sinks are peeled off, then least labels reach forward and backward until
    both agree within a set; members with the same pair of labels share a cycle.
    """
    depth = structural_depth(ped) if depth is None else depth
    open_ = depth.where("depth is null").select("id")
    links = inner_edges(ped).where("child != parent").select("child", "parent").distinct()
    links, seen = counted(links.join(open_.select(F.col("id").alias("child")), "child", "left_semi").join(open_.select(F.col("id").alias("parent")), "parent", "left_semi"), "open-links")
    while True:  # a row that is nobody's parent here, or has no parent here, is in no cycle
        inner = links.join(links.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").join(links.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        fewer, now = counted(inner.select("child", "parent"), "open-links")
        forget(links)
        links = fewer
        if now["n"] == seen["n"]:
            break
        seen = now
    nodes = links.select(F.col("child").alias("id")).distinct()
    cycles = None
    left = stored(nodes, "cycle-nodes")
    while not left.isEmpty():
        forward, backward = (_reach(left, links, a, b) for a, b in (("child", "parent"), ("parent", "child")))
        both = stored(forward.join(backward.withColumnRenamed("label", "other"), "id"), "reach")
        own = both.where("label = other").select("id", F.col("label").alias("cycle"))
        own = own.join(own.groupBy("cycle").count().where("count > 1").select("cycle"), "cycle", "left_semi").select("id", "cycle")
        cycles = own if cycles is None else cycles.unionByName(own)
        left = stored(both.where("label != other").select("id"), "cycle-nodes")
        links = links.join(left.select(F.col("id").alias("child")), "child", "left_semi").join(left.select(F.col("id").alias("parent")), "parent", "left_semi").select("child", "parent")
    return nodes.select("id", F.col("id").alias("cycle")).limit(0) if cycles is None else cycles


def _reach(nodes: DataFrame, links: DataFrame, source: str, target: str) -> DataFrame:
    """The least id among those a node can reach along the links."""
    now, held = nodes.select("id", F.col("id").alias("label")), None
    while True:
        seen = links.join(now.select(F.col("id").alias(target), "label"), target).groupBy(F.col(source).alias("s")).agg(F.min("label").alias("m"))
        then = now.join(seen, F.col("id") == F.col("s"), "left").select("id", F.least("label", "m").alias("label"), (F.col("m") < F.col("label")).alias("moved"))
        then, seen_ = counted(then, "labels", moved=F.count_if(F.col("moved")))
        forget(held)
        held, now = then, then.select("id", "label")
        if not seen_["moved"]:
            return now


def topological(ped: DataFrame, depth: DataFrame, row: str = "row") -> DataFrame:
    return ped.join(depth, "id", "left").orderBy("depth", row)

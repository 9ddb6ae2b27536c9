"""Offspring sex concordance: do siblings share a sex more often than chance?

The groups are aggregated in Spark to five exact integers per grouping; the moments are exact fractions on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUPINGS = {"full_siblings": ("mother", "father"), "maternal": ("mother",), "paternal": ("father",)}


def groups(ped: DataFrame, grouping: str, resolved: bool = False) -> DataFrame:
    """size, males, n: how many groups have this many admitted members and males.

    Only recorded sexes are admitted; ``resolved`` admits imputed ones.  Groups need two admitted members.
    """
    keys = GROUPINGS[grouping]
    rows = ped.where(" and ".join(f"{k} is not null" for k in keys)).where("sex is not null")
    if not resolved and "sex_source" in ped.columns:
        rows = rows.where("sex_source = 'input'")
    one = rows.groupBy(*keys).agg(F.count("*").alias("size"), F.count_if(F.col("sex") == "M").alias("males"))
    return one.where("size >= 2").groupBy("size", "males").agg(F.count("*").alias("n"))


def by_size(table: DataFrame) -> DataFrame:
    """Per group size: groups, males, concordant pairs."""
    m, k = F.col("males"), F.col("size") - F.col("males")
    return table.groupBy("size").agg(F.sum("n").alias("n_groups"), F.sum(m * F.col("n")).alias("n_males"), F.sum((m * (m - 1) + k * (k - 1)) / 2 * F.col("n")).cast("long").alias("concordant_pairs"))


def sums(table: DataFrame) -> DataFrame:
    """P (pairs), S (sum of size^3-type terms, as sum of pair products), members, males, concordant pairs, groups; exact."""
    d = lambda c: c.cast("decimal(38,0)")
    s, m, n = d(F.col("size")), d(F.col("males")), d(F.col("n"))
    f = s - m
    half = lambda x: (x * (x - 1) / 2).cast("decimal(38,0)")
    return table.agg(F.sum("n").alias("n_groups"), F.sum((half(s) * n).cast("decimal(38,0)")).alias("pairs"), F.sum((s * (s - 1) * (s - 2) * n).cast("decimal(38,0)")).alias("triples"), F.sum(s * n).cast("decimal(38,0)").alias("members"), F.sum(m * n).cast("decimal(38,0)").alias("males"), F.sum(((half(m) + half(f)) * n).cast("decimal(38,0)")).alias("concordant"))


def moments(pairs: int, triples: int, members: int, males: int) -> tuple[Fraction, Fraction]:
    """Exact mean and variance of the concordant pairs when the males are dealt at random over all members.

    With I_p the concordance of pair p: E I = q2; pairs that share a member (``triples`` ordered ones) agree jointly if three
    have one sex; disjoint pairs by the four-member probabilities.
    """
    n, m = members, males
    f = n - m
    falling = lambda x, k: math.prod(x - i for i in range(k))
    q2 = Fraction(falling(m, 2) + falling(f, 2), falling(n, 2))
    mean = pairs * q2
    q3 = Fraction(falling(m, 3) + falling(f, 3), falling(n, 3)) if n >= 3 else Fraction(0)
    q22 = Fraction(falling(m, 4) + falling(f, 4) + 2 * falling(m, 2) * falling(f, 2), falling(n, 4)) if n >= 4 else Fraction(0)
    apart = pairs * pairs - pairs - triples  # ordered pairs of pairs without a common member
    return mean, pairs * q2 + triples * q3 + apart * q22 - mean * mean


def holm(p: list[float]) -> list[float]:
    """Step-down adjusted p-values."""
    order = sorted(range(len(p)), key=p.__getitem__)
    out, top = [0.0] * len(p), 0.0
    for i, k in enumerate(order):
        top = max(top, min(1.0, (len(p) - i) * p[k]))
        out[k] = top
    return out


def test(table: DataFrame) -> dict:
    """One grouping: counts, expectation, z and two-sided p; or the reason why not."""
    r = sums(table).first()
    got = {k: int(r[k] or 0) for k in ("n_groups", "pairs", "triples", "members", "males", "concordant")}
    if got["members"] == 0:
        return got | {"skipped": "no_input_sex"}
    if got["n_groups"] < 2:
        return got | {"skipped": "fewer_than_two_eligible_groups"}
    if got["males"] in (0, got["members"]):
        return got | {"skipped": "single_sex"}
    mean, var = moments(got["pairs"], got["triples"], got["members"], got["males"])
    if var <= 0:
        return got | {"skipped": "zero_variance"}
    z = float(got["concordant"] - mean) / math.sqrt(var)
    return got | {"expected": float(mean), "variance": float(var), "z": z, "p": math.erfc(abs(z) / math.sqrt(2)), "rate": got["concordant"] / got["pairs"]}


def permutations(spark: SparkSession, table: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """draw, concordant: males dealt at random over all groups, by sequential conditional hypergeometric draws.

    Only how many groups have each size matters, so what is sent to the tasks is one row per size.
    """
    sizes = table.groupBy("size").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("males")).alias("m")).orderBy("size").collect()
    size, count = np.array([r["size"] for r in sizes]), np.array([r["n"] for r in sizes])
    males = int(sum(r["m"] for r in sizes))

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k in part["id"]:
                rng = np.random.default_rng([seed, int(k)])
                left_m, left_n, total = males, int((size * count).sum()), 0
                for s, c in zip(size.tolist(), count.tolist(), strict=True):
                    here = rng.hypergeometric(left_m, left_n - left_m, s * c) if left_n else 0
                    left_m, left_n = left_m - here, left_n - s * c
                    m = rng.multivariate_hypergeometric(np.full(c, s), here, method="marginals") if c > 1 else np.array([here])
                    total += int((m * (m - 1) // 2 + (s - m) * (s - m - 1) // 2).sum())
                out.append(total)
            yield pd.DataFrame({"draw": part["id"], "concordant": out})

    return spark.range(draws).mapInPandas(draw, "draw long, concordant long")


def permutation_p(spark: SparkSession, table: DataFrame, draws: int = 999, seed: int = 1) -> float:
    """Two-sided: (draws as far from the mean as observed + 1) / (draws + 1)."""
    got = test(table)
    far = F.abs(F.col("concordant") - got["expected"]) >= abs(got["concordant"] - got["expected"]) - 1e-9
    return (permutations(spark, table, draws, seed).where(far).count() + 1) / (draws + 1)


def concordance(ped: DataFrame) -> dict[str, dict]:
    """All groupings, headline and sensitivity, with Holm's adjustment over the headline tests."""
    out = {g: {"input": test(groups(ped, g)), "resolved": test(groups(ped, g, True))} for g in GROUPINGS}
    done = [g for g in out if "p" in out[g]["input"]]
    for g, p in zip(done, holm([out[g]["input"]["p"] for g in done]), strict=True):
        out[g]["input"]["p_holm"] = p
    return out

"""Mate correlation: traits of the two members of each mating pair, by the estimator their kinds call for."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions import normal
from kinfold.functions.tokens import stratum
from kinfold.operators.graph import components
from kinfold.operators.individual import mating_pairs
from kinfold.session import counted, numbered, stored


#: Fewest Mate Networks that a stratum's pairs must span.
MIN_STRATUM_NETWORKS = 10
#: A table of levels by levels goes to the driver; a trait with more is refused, not cut.
MOST_LEVELS = 1000


class TraitError(ValueError):
    """A trait column that can't be typed."""


# Words for the two levels of a binary trait.
WORDS = (("false", "true"), ("no", "yes"))


def trait_levels(tokens: DataFrame) -> DataFrame:
    """level and code (0, 1, ... by value) of each distinct token; codes rank levels, not rows."""
    t = F.lower(F.trim("token"))
    number = t.try_cast("double")
    levels = tokens.where("token is not null").select(t.alias("level"), number.isNull().alias("word"), number.alias("x")).groupBy("level", "word", "x").agg(F.count("*").alias("n"))
    return numbered(levels, "word", "x", "level", name="code").select("level", "n", (F.col("code") - 1).cast("int").alias("code"))


def classify_trait(tokens: DataFrame, stated: str | None = None, most_levels: int = 20) -> tuple[str, dict[str, int] | None]:
    """binary, ordinal or continuous, and the codes of its levels; one aggregate and at most a few levels reach the driver."""
    t = F.lower(F.trim("token"))
    x = t.try_cast("double")
    a = tokens.where("token is not null").agg(F.countDistinct(t).alias("levels"), F.count_if(x.isNull()).alias("words"), F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias("odd")).first()
    if a["levels"] == 0:
        raise TraitError("every value is missing")
    if a["levels"] == 1:
        raise TraitError("the trait is constant")
    if a["odd"]:
        raise TraitError("a value isn't finite")
    kind = stated or ("binary" if a["levels"] <= 2 else "continuous" if a["levels"] > most_levels and not a["words"] else None)
    if kind is None:
        raise TraitError(f"{a['levels']} levels: state whether the trait is ordinal or continuous")
    if kind == "continuous":
        if a["words"]:
            raise TraitError("a value isn't a number")
        return kind, None
    if kind == "binary" and a["levels"] != 2:
        raise TraitError("a binary trait has two levels")
    if a["levels"] > MOST_LEVELS:
        raise TraitError(f"{a['levels']} levels: an ordinal trait has {MOST_LEVELS} at most")
    levels = [r["level"] for r in trait_levels(tokens).orderBy("code").collect()]
    if a["words"] and not (kind == "binary" and tuple(sorted(levels)) in WORDS):
        raise TraitError("levels that aren't numbers must be false and true, or no and yes")
    return kind, {v: i for i, v in enumerate(levels)}


def mate_networks(ped: DataFrame) -> DataFrame:
    """id and network: components over mating pairs only."""
    pairs = stored(mating_pairs(ped).select(F.col("mother").alias("a"), F.col("father").alias("b")), "mates")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return components(nodes, pairs).withColumnRenamed("component", "network")


def mate_values(ped: DataFrame, traits: DataFrame, columns: list[str]) -> DataFrame:
    """mother, father and each member's traits (m_x, f_x) of every mating pair."""
    out = mating_pairs(ped).select("mother", "father")
    for who, p in (("mother", "m"), ("father", "f")):
        out = out.join(traits.select(F.col("id").alias(who), *(F.col(c).alias(f"{p}_{c}") for c in columns)), who, "left")
    return out.select("mother", "father", *(f"{p}_{c}" for c in columns for p in ("m", "f")))


def pair_strata(ped: DataFrame, width: int | None = None) -> DataFrame:
    """mother, father and each member's stratum: depth, or the birth year's bin."""
    s = stratum(F.col("birth_year"), width) if width else F.col("depth")
    own = ped.select("id", s.alias("s"))
    out = mating_pairs(ped).select("mother", "father")
    for who in ("mother", "father"):
        out = out.join(own.select(F.col("id").alias(who), F.col("s").alias(f"{who}_stratum")), who, "left")
    return out


def drop_counts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs used, and those dropped for a missing mother's, father's or both values."""
    m, f = F.col(f"m_{a}").isNull(), F.col(f"f_{b}").isNull()
    return pairs.agg(F.count_if(~m & ~f).alias("used"), F.count_if(m & ~f).alias("mother_missing"), F.count_if(~m & f).alias("father_missing"), F.count_if(m & f).alias("both_missing"))


def within_strata(pairs: DataFrame, column: str, by: str) -> Column:
    """Standardised within a stratum."""
    w = W.partitionBy(by)
    return (F.col(column) - F.avg(column).over(w)) / F.nullif(F.stddev_pop(column).over(w), F.lit(0.0))


def full_strata(pairs: DataFrame, a: str, b: str, least: int = MIN_STRATUM_NETWORKS) -> tuple[DataFrame, dict[str, int]]:
    """The pairs of a cell whose strata count, and how many were dropped for which reason.

    Pairs without both values or with an unknown stratum go first.  A mother's (father's) stratum is *thin* if its pairs
    span fewer than ``least`` Mate Networks of the pairs still in, *degenerate* if its values don't vary.  Dropping a
    stratum's pairs may empty others, so this is repeated until nothing changes; a round drops a stratum or is the last.
    """
    rows = pairs.select("mother", "father", F.col(f"m_{a}").alias("x"), F.col(f"f_{b}").alias("y"), "mother_stratum", "father_stratum").where("x is not null and y is not null")
    known = F.col("mother_stratum").isNotNull() & F.col("father_stratum").isNotNull()
    drops = {"unknown_stratum": rows.where(~known).count(), "thin_stratum": 0, "degenerate_stratum": 0}
    now = stored(rows.where(known), "strata")
    while True:
        links = now.select(F.col("mother").alias("a"), F.col("father").alias("b"))
        nets = components(links.select(F.col("a").alias("id")).distinct(), links).select(F.col("id").alias("mother"), F.col("component").alias("network"))
        now = stored(now.join(nets, "mother"), "strata")
        then = now
        for role, value in (("mother", "x"), ("father", "y")):
            cell = now.groupBy(f"{role}_stratum").agg(F.countDistinct("network").alias("g"), (F.max(value) > F.min(value)).alias("varies"))
            why = F.when(F.col("g") < least, "thin").when(~F.col("varies"), "degenerate")
            then = then.join(cell.select(f"{role}_stratum", why.alias(f"_{role}")), f"{role}_stratum", "left")
        first = F.coalesce("_mother", "_father")
        then, n = counted(then.withColumn("_why", first).drop("_mother", "_father"), "strata", thin=F.count_if(F.col("_why") == "thin"), degenerate=F.count_if(F.col("_why") == "degenerate"))
        drops["thin_stratum"] += n["thin"]
        drops["degenerate_stratum"] += n["degenerate"]
        now = then.where("_why is null").drop("_why")
        if n["thin"] + n["degenerate"]:
            now = now.drop("network")
        else:
            return now.select("mother", "father", "network", "mother_stratum", "father_stratum", F.col("x").alias(f"m_{a}"), F.col("y").alias(f"f_{b}")), drops


def _used(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select("mother", "father", F.col(f"m_{a}").alias("x"), F.col(f"f_{b}").alias("y")).where("x is not null and y is not null")


def pearson(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return _used(pairs, a, b).agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """value and its average rank, without a window over everything: ranges, their totals, then a window in each range."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranged = stored(counts.repartitionByRange("value").withColumn("p", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("p").agg(F.sum("n").alias("t"))
    before = totals.select("p", (F.sum("t").over(W.orderBy("p")) - F.col("t")).alias("before"))  # one row per partition
    at = F.sum("n").over(W.partitionBy("p").orderBy("value"))
    return ranged.join(F.broadcast(before), "p").select("value", (F.col("before") + at - (F.col("n") - 1) / 2).alias("rank"))


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    used = stored(_used(pairs, a, b), "used")
    x, y = (average_ranks(used, c).withColumnsRenamed({"value": c, "rank": f"r{c}"}) for c in ("x", "y"))
    return used.join(x, "x").join(y, "y").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def cross_table(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return _used(pairs, a, b).groupBy("x", "y").agg(F.count("*").alias("n"))


def two_by_two(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The four counts, the odds ratio with the standard error of its logarithm and its 95 % interval, and phi."""
    x, y = F.col("x") > 0, F.col("y") > 0
    t = _used(pairs, a, b).agg(F.count_if(~x & ~y).alias("n00"), F.count_if(~x & y).alias("n01"), F.count_if(x & ~y).alias("n10"), F.count_if(x & y).alias("n11"))
    n00, n01, n10, n11 = (F.col(c).cast("double") for c in ("n00", "n01", "n10", "n11"))
    margins = (n00 + n01) * (n10 + n11) * (n00 + n10) * (n01 + n11)
    positive = (n00 > 0) & (n01 > 0) & (n10 > 0) & (n11 > 0)
    odds, se = n00 * n11 / (n01 * n10), F.sqrt(1 / n00 + 1 / n01 + 1 / n10 + 1 / n11)
    q = normal.quantile(0.975)
    interval = [F.when(positive, F.exp(F.ln(odds) + sign * q * se)).alias(f"odds_ratio_{name}") for name, sign in (("low", -1), ("high", 1))]
    return t.select("n00", "n01", "n10", "n11", F.when(positive, odds).alias("odds_ratio"), F.when(positive, se).alias("se_log_odds"), *interval, F.when(margins > 0, (n00 * n11 - n01 * n10) / F.sqrt(margins)).alias("phi"))


# Latent correlations -------------------------------------------------------------------------------------------------


def _thresholds(margin: np.ndarray) -> np.ndarray:
    share = np.cumsum(margin)[:-1] / margin.sum()
    return np.array([-np.inf, *(normal.quantile(float(p)) for p in share), np.inf])


def _maximum(f, lo: float = -0.999, hi: float = 0.999) -> float:
    """The maximum of a unimodal function, by golden section."""
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    while hi - lo > 1e-9:
        if fa < fb:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
        else:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
    return (lo + hi) / 2


def polychoric(table: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Estimate from a table of counts (2 x 2: tetrachoric), the score of each cell, and the information."""
    rows, columns = _thresholds(table.sum(1)), _thresholds(table.sum(0))
    like = lambda r: float((table * np.log(normal.cells(rows, columns, r))).sum())
    r, e = _maximum(like), 1e-4
    lo, mid, hi = (np.log(normal.cells(rows, columns, max(-0.9999, min(0.9999, x)))) for x in (r - e, r, r + e))
    return r, (hi - lo) / (2 * e), float(-(table * (hi - 2 * mid + lo)).sum() / e**2)


def _serial_logs(z: np.ndarray, level: np.ndarray, cut: np.ndarray, r: float) -> np.ndarray:
    s = math.sqrt(1 - r * r)
    return np.log(np.maximum(normal.cdf((cut[level + 1] - r * z) / s) - normal.cdf((cut[level] - r * z) / s), 1e-12))


def _grid_likelihood(used: DataFrame, mean: float, sd: float, cut: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Log likelihoods at all grid points in one pass; a task returns one sum per point."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(grid))
        for p in parts:
            z, level = (p["x"].to_numpy() - mean) / sd, p["y"].to_numpy().astype(int)
            total += [_serial_logs(z, level, cut, r).sum() for r in grid]
        yield pd.DataFrame({"i": range(len(grid)), "v": total})

    rows = used.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(grid))
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def polyserial(used: DataFrame) -> tuple[float, float, float, np.ndarray]:
    """x continuous, y coded 0, 1, ...: the estimate, x's mean and sd, y's thresholds; three passes of finer grids."""
    a = used.agg(F.avg("x"), F.stddev_pop("x")).first()
    counts = {int(r["y"]): r["n"] for r in used.groupBy("y").agg(F.count("*").alias("n")).collect()}
    cut = _thresholds(np.array([counts.get(k, 0) for k in range(max(counts) + 1)], float))
    lo, hi = -0.99, 0.99
    for _ in range(4):
        grid = np.linspace(lo, hi, 25)
        best = int(_grid_likelihood(used, a[0], a[1], cut, grid).argmax())
        lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    return float(grid[best]), a[0], a[1], cut


def _clustered(scores: DataFrame, information: float) -> tuple[float, int]:
    """Sandwich standard error over networks: (network, score) summed by network, G / (G - 1)."""
    by = scores.groupBy("network").agg(F.sum("score").alias("s"))
    t = by.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.count("*").alias("g")).first()
    g = t["g"]
    return (math.sqrt(g / (g - 1) * t["ss"]) / information if g > 1 and information > 0 else math.nan), g


def wald(r: float, se: float, level: float = 0.95) -> tuple[float, float]:
    """On Fisher's z."""
    if not abs(r) < 1 or math.isnan(se):
        return math.nan, math.nan
    q, z = normal.quantile(0.5 + level / 2), math.atanh(r)
    w = q * se / (1 - r * r)
    return math.tanh(z - w), math.tanh(z + w)


def influence(used: DataFrame, r: float) -> DataFrame:
    """network and score of Pearson's r: z_x z_y - r (z_x^2 + z_y^2) / 2."""
    m = used.agg(F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"), F.avg("y").alias("my"), F.stddev_pop("y").alias("sy")).first()
    zx, zy = (F.col("x") - m["mx"]) / m["sx"], (F.col("y") - m["my"]) / m["sy"]
    return used.select("network", (zx * zy - r * (zx * zx + zy * zy) / 2).alias("score"))


class Fit(NamedTuple):
    """An estimate's record, the score of each pair by network, and the information."""

    record: dict
    scores: DataFrame
    information: float


def _tables(used: DataFrame, by: list[str]) -> tuple[dict[tuple, np.ndarray], list, list]:
    """A table of counts for each pair of strata (one without strata), over all levels; strata and levels are few."""
    rows = used.groupBy(*by, "x", "y").agg(F.count("*").alias("n")).collect()
    xs, ys = sorted({r["x"] for r in rows}), sorted({r["y"] for r in rows})
    tables: dict[tuple, np.ndarray] = {}
    for r in rows:
        t = tables.setdefault(tuple(r[c] for c in by), np.zeros((len(xs), len(ys))))
        t[xs.index(r["x"]), ys.index(r["y"])] = r["n"]
    return tables, xs, ys


def stratified_polychoric(tables: dict[tuple, np.ndarray]) -> tuple[float, dict[tuple, np.ndarray], float]:
    """One correlation with thresholds of each mother's and father's stratum: keys are (mother's, father's) strata, or ()."""
    mothers: dict = {}
    fathers: dict = {}
    for k, t in tables.items():
        mothers[k[:1]] = mothers.get(k[:1], 0) + t.sum(1)
        fathers[k[1:]] = fathers.get(k[1:], 0) + t.sum(0)
    cuts = {k: (_thresholds(mothers[k[:1]]), _thresholds(fathers[k[1:]])) for k in tables}
    logs = lambda r: {k: np.log(np.maximum(normal.cells(*c, max(-0.9999, min(0.9999, r))), 1e-300)) for k, c in cuts.items()}
    r = _maximum(lambda v: sum(float((tables[k] * x).sum()) for k, x in logs(v).items()))
    e = 1e-4
    lo, mid, hi = logs(r - e), logs(r), logs(r + e)
    info = -sum(float((tables[k] * (hi[k] - 2 * mid[k] + lo[k])).sum()) for k in tables) / e**2
    return r, {k: (hi[k] - lo[k]) / (2 * e) for k in tables}, info


def fit(pairs: DataFrame, networks: DataFrame, a: str, b: str, kinds: tuple[str, str], strata: bool = False) -> Fit:
    """The primary estimator for the kinds of a and b, its network standard error and interval.

    With ``strata`` (columns mother_stratum, father_stratum) categorical traits have thresholds by stratum; continuous ones
    come standardised within strata.
    """
    by = ["mother_stratum", "father_stratum"] if strata else []
    used = pairs.select("mother", *by, F.col(f"m_{a}").alias("x"), F.col(f"f_{b}").alias("y")).where("x is not null and y is not null")
    used = stored(used.join(networks.withColumnRenamed("id", "mother"), "mother"), "used")
    if kinds == ("continuous", "continuous"):
        got = used.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r")).first()
        name, n, r, info = "pearson", got["n"], got["r"], got["n"]
        scores = influence(used, r)
    elif "continuous" in kinds:
        if kinds[1] == "continuous":
            used = used.select("network", F.col("y").alias("x"), F.col("x").alias("y"))
        n = used.count()
        r, mean, sd, cut = polyserial(used)
        name = "biserial" if "binary" in kinds else "polyserial"

        def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                z, level, e = (p["x"].to_numpy() - mean) / sd, p["y"].to_numpy().astype(int), 1e-4
                lo, mid, hi = (_serial_logs(z, level, cut, max(-0.9999, min(0.9999, v))) for v in (r - e, r, r + e))
                yield pd.DataFrame({"network": p["network"], "score": (hi - lo) / (2 * e), "info": -(hi - 2 * mid + lo) / e**2})

        scores = stored(used.select("network", "x", "y").mapInPandas(score, "network long, score double, info double"), "scores")
        info = scores.agg(F.sum("info")).first()[0]
    else:
        tables, xs, ys = _tables(used, by)
        n = int(sum(t.sum() for t in tables.values()))
        r, cell, info = stratified_polychoric(tables)
        name = "tetrachoric" if (len(xs), len(ys)) == (2, 2) else "polychoric"
        rows = [(*k, float(x), float(y), float(c[i, j])) for k, c in cell.items() for i, x in enumerate(xs) for j, y in enumerate(ys)]
        known = pairs.sparkSession.createDataFrame(rows, ", ".join([*(f"{c} {dict(used.dtypes)[c]}" for c in by), "x double", "y double", "score double"]))
        scores = used.join(F.broadcast(known), [*by, "x", "y"]).select("network", "score")  # strata x strata x levels x levels
    scores = stored(scores.select("network", "score"), "scores")
    se, g = _clustered(scores, info)
    low, high = wald(r, se)
    return Fit({"estimator": name, "n": int(n), "n_networks": g, "estimate": float(r), "se": float(se), "ci_low": low, "ci_high": high}, scores, float(info))


def estimate(pairs: DataFrame, networks: DataFrame, a: str, b: str, kinds: tuple[str, str], strata: bool = False) -> dict:
    return fit(pairs, networks, a, b, kinds, strata).record


def bootstrap(scores: DataFrame, r: float, information: float, draws: int = 200, seed: int = 1) -> DataFrame:
    """draw and one-step estimate with Poisson weights per network, drawn from hashes."""
    by = scores.groupBy("network").agg(F.sum("score").alias("s"))
    u = (F.pmod(F.xxhash64("network", "draw", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    edges, p, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += p
        edges.append(total)
        p /= k + 1
    weight = sum((F.when(u > e, 1).otherwise(0) for e in edges), F.lit(0))
    many = by.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    # Given their total, Poisson weights are multinomial ones; the total's own variation is divided out.
    return many.groupBy("draw").agg((F.lit(r) + F.sum(F.col("w") * F.col("s")) / F.sum("w") * F.count("*") / information).alias("estimate"))


def null_scores(pairs: DataFrame, column: str, kind: str, by: str | None = None) -> Column:
    """What a value counts for at a correlation of 0: itself, standardised, or its level's mean on a normal scale.

    For categorical traits the product of both members' scores is the derivative of the likelihood there.
    """
    v = F.col(column)
    if kind == "continuous":
        m = pairs.agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s")).first()
        return (v - F.lit(m["m"])) / F.lit(m["s"])
    keys = [by] if by else []
    counts = pairs.where(v.isNotNull()).groupBy(*keys, v.alias("v")).agg(F.count("*").alias("n")).collect()  # strata x levels
    out = F.lit(None).cast("double")
    for s in {tuple(r[k] for k in keys) for r in counts}:
        own = sorted((r["v"], r["n"]) for r in counts if tuple(r[k] for k in keys) == s)
        total, below = sum(n for _, n in own), 0
        for level, n in own:
            lo, hi = below / total, (below + n) / total
            density = [math.exp(-(normal.quantile(p) ** 2) / 2) / math.sqrt(2 * math.pi) if 0 < p < 1 else 0.0 for p in (lo, hi)]
            here = v == F.lit(level)
            for k, x in zip(keys, s, strict=True):
                here = here & F.col(k).eqNullSafe(F.lit(x))
            out = F.when(here, F.lit((density[0] - density[1]) / (n / total))).otherwise(out)
            below += n
    return out


def permutations(pairs: DataFrame, a: str, b: str, draws: int = 999, seed: int = 1, stratum_column: str | None = None, kinds: tuple[str, str] = ("continuous", "continuous"), first: int = 0, blocks: tuple[str, ...] = ()) -> DataFrame:
    """draw and statistic (the sum of both members' scores at a correlation of 0) with the fathers' values dealt anew within a
    block; draw 0 is observed.  A block is a father's stratum and which of ``blocks`` (other traits of his) are missing.

    Hashes order the fathers in each draw, so a draw is a sort, not a driver loop; the mothers are numbered once.
    """
    x = null_scores(pairs, f"m_{a}", kinds[0], "mother_stratum" if stratum_column else None)
    y = null_scores(pairs, f"f_{b}", kinds[1], stratum_column)
    missing = [F.col(c).isNull().cast("string") for c in blocks]
    block = F.concat_ws("|", F.col(stratum_column).cast("string") if stratum_column else F.lit(""), *missing)
    z = pairs.where(F.col(f"m_{a}").isNotNull() & F.col(f"f_{b}").isNotNull()).select("mother", "father", block.alias("s"), x.alias("zx"), y.alias("zy"))
    z = stored(z.withColumn("i", F.row_number().over(W.partitionBy("s").orderBy(F.xxhash64("mother", "father"), "mother", "father"))), "scored")
    many = z.select("mother", "father", "s", "i", "zy", F.explode(F.sequence(F.lit(first), F.lit(draws))).alias("draw"))
    order = F.when(F.col("draw") == 0, F.col("i")).otherwise(F.xxhash64("father", "mother", "draw", F.lit(seed)))
    dealt = many.select("draw", "s", "zy", F.row_number().over(W.partitionBy("draw", "s").orderBy(order, "i")).alias("i"))
    return z.select("s", "i", "zx").join(dealt, ["s", "i"]).groupBy("draw").agg(F.sum(F.col("zx") * F.col("zy")).alias("statistic"))


def permutation_p(pairs: DataFrame, a: str, b: str, draws: int, seed: int = 1, batch: int = 200, stop: int = 20, **options) -> tuple[float, int]:
    """The sequential p-value; draws come in batches, and no batch is made once ``stop`` draws were as far out as observed."""
    values: list[float] = []
    observed = None
    for begin in range(0, draws + 1, batch):
        got = {r["draw"]: r["statistic"] for r in permutations(pairs, a, b, min(draws, begin + batch - 1), seed, first=begin, **options).collect()}
        observed = got.pop(0) if observed is None else observed
        values += [got[k] for k in sorted(got)]
        p, used = sequential_p(values, observed, stop)
        if sum(abs(v) >= abs(observed) for v in values) >= stop:
            return p, used
    return sequential_p(values, observed or 0.0, stop)


def sequential_p(statistics: list[float], observed: float, stop: int = 20) -> tuple[float, int]:
    """Stops once ``stop`` draws are as far out as observed: hits / draws then, else (hits + 1) / (draws + 1)."""
    hits = 0
    for i, v in enumerate(statistics, 1):
        hits += abs(v) >= abs(observed)
        if hits == stop:
            return hits / i, i
    return (hits + 1) / (len(statistics) + 1), len(statistics)


def cross_trait(ped: DataFrame, traits: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of two traits within the distinct persons of mating pairs."""
    people = mating_pairs(ped).select(F.explode(F.array("mother", "father")).alias("id")).distinct()
    return people.join(traits, "id").where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.corr(a, b).alias("r"))

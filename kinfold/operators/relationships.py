"""Relationship codes of pairs, up to the fifth degree.

C(u, d) of a pair is the number of ways to go u steps up from one and d steps down to the other.  A *full* category needs two
ways, a *half* one or a lineal needs one; each unordered pair takes the closest category it matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.operators.graph import closure
from kinfold.session import stored

# Code, degree, steps up, steps down, ways needed; in order of precedence.
CODES = (
    ("MZ", 0, 0, 0, 0),
    ("MO", 1, 1, 0, 1),
    ("FO", 1, 1, 0, 1),
    ("FS", 1, 1, 1, 2),
    ("MHS", 2, 1, 1, 1),
    ("PHS", 2, 1, 1, 1),
    ("GP", 2, 2, 0, 1),
    ("Av", 2, 2, 1, 2),
    ("GGP", 3, 3, 0, 1),
    ("HAv", 3, 2, 1, 1),
    ("GAv", 3, 3, 1, 2),
    ("1C", 3, 2, 2, 2),
    ("GGGP", 4, 4, 0, 1),
    ("HGAv", 4, 3, 1, 1),
    ("GGAv", 4, 4, 1, 2),
    ("H1C", 4, 2, 2, 1),
    ("1C1R", 4, 3, 2, 2),
    ("G3GP", 5, 5, 0, 1),
    ("HGGAv", 5, 4, 1, 1),
    ("G3Av", 5, 5, 1, 2),
    ("H1C1R", 5, 3, 2, 1),
    ("1C2R", 5, 4, 2, 2),
    ("2C", 5, 3, 3, 2),
)
DEGREE = {c[0]: c[1] for c in CODES}
ORDER = {c[0]: i for i, c in enumerate(CODES)}


#: Rows of a task in which families meet: they are held in memory by pair of families.
ROWS = 400_000
_LINEAL_OR_SIB = ("MZ", "MO", "FO", "MHS", "PHS")


def _rank(codes: list[tuple], collateral: bool) -> Column:
    """The place of the closest code that (u, d, ways) matches, of those with or without steps down."""
    by_steps: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for code, _, u, d, ways in codes:
        if code not in _LINEAL_OR_SIB and bool(d) == collateral:
            by_steps.setdefault((u, d), []).append((ORDER[code], ways))
    rank = F.lit(None).cast("int")
    for (u, d), options in by_steps.items():
        here = F.lit(None).cast("int")
        for place, ways in sorted(options, reverse=True):
            here = F.when(F.col("ways") >= ways, place).otherwise(here)
        rank = F.when((F.col("u") == u) & (F.col("d") == d), here).otherwise(rank)
    return rank


class Kin:
    """Related pairs by families.

    Full siblings, and others with the same recorded parents, have the same ways up, so u steps up and d steps down with both
    at least 1 are counted between *families* (named by the least id), one ancestor, number of steps up and family at a time.
    Lines of descent and parents are kept by family and ancestor, and only linked twins by person.  Counts, burdens and
    densities follow from family sizes; pairs of persons are made only if asked for.

    members: id, fam, size; line: fam, anc, rank, size, g (the ancestor's family); linked: lo, hi, f, g (linked twins);
    families: fam_a <= fam_b, size_a, size_b, rank_a (least rank with a member of fam_a as the junior), rank_b, near (whether
    a line or a twin link lies between the two).
    """

    def __init__(self, ped: DataFrame, paths: DataFrame | None, max_degree: int = 5, twins: DataFrame | None = None) -> None:
        """``paths`` may be left out: they are needed for one member of each family only."""
        self.ped, self.max_degree = ped, max_degree
        codes = [c for c in CODES if c[1] <= max_degree]
        has_row = ped.select(F.col("id").alias("parent"))
        whole = W.partitionBy("mother", "father")
        of = ped.where("mother is not null or father is not null")
        self.members = stored(of.select("id", F.min("id").over(whole).alias("fam"), F.count("*").over(whole).alias("size"), "mother", "father"), "members")
        heads = self.members.where("id = fam").select("fam", "size", "mother", "father")
        top = max((u for _, _, u, _, _ in codes), default=0)
        own = heads.select(F.col("fam").alias("id"), "size")
        paths = closure(ped, top, of=own.select("id")) if paths is None else paths
        near = stored(paths.where((F.col("gen") >= 1) & (F.col("gen") <= top)).join(own, "id"), "near")
        fam = self.members.select("id", "fam")
        self.line = stored(self._line(codes, heads, near, has_row).join(fam.select(F.col("id").alias("anc"), F.col("fam").alias("g")), "anc", "left"), "line")
        self.linked = None
        if twins is not None:
            pairs = twins.where("id1 != id2").select(F.least("id1", "id2").alias("lo"), F.greatest("id1", "id2").alias("hi")).distinct()
            pairs = pairs.join(fam.select(F.col("id").alias("lo"), F.col("fam").alias("f")), "lo", "left").join(fam.select(F.col("id").alias("hi"), F.col("fam").alias("g")), "hi", "left")
            self.linked = stored(pairs.select("lo", "hi", "f", "g"), "linked")
        self.families = stored(self._families(codes, heads, near, has_row), "kin")

    def _line(self, codes: list[tuple], heads: DataFrame, near: DataFrame, has_row: DataFrame) -> DataFrame:
        """fam, size, anc, rank: the closest lineal code of a family's members to an ancestor."""
        up = near.select(F.col("id").alias("fam"), "size", "anc", F.col("gen").alias("u"), F.lit(0).alias("d"), F.col("n").alias("ways"))
        parts = [up.select("fam", "size", "anc", _rank(codes, False).alias("rank")).where("rank is not null")]
        for role, code in (("mother", "MO"), ("father", "FO")):
            if DEGREE[code] <= self.max_degree:
                named = heads.select("fam", "size", F.col(role).alias("parent")).join(has_row, "parent", "left_semi")
                parts.append(named.select("fam", "size", F.col("parent").alias("anc"), F.lit(ORDER[code]).alias("rank")))
        return reduce(DataFrame.unionByName, parts).groupBy("fam", "anc").agg(F.max("size").alias("size"), F.min("rank").alias("rank"))

    def _families(self, codes: list[tuple], heads: DataFrame, near: DataFrame, has_row: DataFrame) -> DataFrame:
        """Rows of families and ancestors meet once, by pair of families: ways, half-sibs and marks of lines and twins alike."""
        ups: dict[int, list[int]] = {}
        for _, _, u, d, _ in codes:
            if d and u not in ups.setdefault(d, []):
                ups[d].append(u)
        x_least, none = F.col("x") <= F.col("y"), F.lit(None).cast("long")
        n_rows = self._n_met(near, ups)

        def rows(df: DataFrame, u: Column, d: Column, n: Column) -> DataFrame:
            """x is the junior unless both go as far; sizes go with their families."""
            sx, sy = (F.col(c) if c in df.columns else none for c in ("sx", "sy"))
            return df.select(F.least("x", "y").alias("fam_a"), F.greatest("x", "y").alias("fam_b"), ((u + 1) * 64 + (d + 1) * 2 + x_least.cast("int")).cast("int").alias("way"), F.when(x_least, sx).otherwise(sy).alias("size_a"), F.when(x_least, sy).otherwise(sx).alias("size_b"), n.cast("long").alias("n"))

        parts = []
        if ups:
            wanted = F.create_map(*(x for d, us in ups.items() for x in (F.lit(d), F.array(*map(F.lit, sorted(us))))))
            x = near.select("anc", F.col("gen").alias("u"), F.col("id").alias("x"), F.col("size").alias("sx"), F.col("n").alias("nx"))
            y = near.where(F.col("gen") <= max(ups)).select("anc", F.explode(F.try_element_at(wanted, F.col("gen"))).alias("u"), F.col("gen").alias("d"), F.col("id").alias("y"), F.col("size").alias("sy"), F.col("n").alias("ny"))
            tasks = 1 + n_rows // (2 * ROWS)  # a row that is joined makes many
            x, y = x.repartition(tasks, "anc", "u"), y.repartition(tasks, "anc", "u")
            parts.append(rows(x.join(y, ["anc", "u"]).where("u > d or x <= y"), F.col("u"), F.col("d"), F.col("nx") * F.col("ny")))
        for role, code in (("mother", "MHS"), ("father", "PHS")):
            if DEGREE[code] <= self.max_degree:  # u = 0: the code's place stands in d
                own = heads.join(has_row, F.col(role) == F.col("parent"), "left_semi").select("fam", "size", role)
                halves = own.select(F.col("fam").alias("x"), F.col("size").alias("sx"), role).join(own.select(F.col("fam").alias("y"), F.col("size").alias("sy"), role), role).where("x <= y")
                parts.append(rows(halves, F.lit(0), F.lit(ORDER[code]), F.lit(1)))
        marks = [self.line.where("g is not null").select(F.col("fam").alias("x"), F.col("g").alias("y")).distinct()]
        if self.linked is not None:
            marks.append(self.linked.where("f is not null and g is not null").select(F.col("f").alias("x"), F.col("g").alias("y")))
        parts += [rows(m, F.lit(-1), F.lit(-1), F.lit(1)) for m in marks]
        met = reduce(DataFrame.unionByName, parts).repartition(1 + n_rows // ROWS, "fam_a", "fam_b")
        met = met.groupBy("fam_a", "fam_b", "way").agg(F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"), F.sum("n").alias("ways"))
        way = F.col("way")
        met = met.withColumns({"up_a": way % 2 == 1, "d": F.floor(way / 2) % 32 - 1, "u": F.floor(way / 64) - 1})
        rank = F.when(F.col("u") == 0, F.col("d").cast("int")).otherwise(_rank(codes, True))
        even = (F.col("u") == F.col("d")) | (F.col("u") == 0) | (F.col("fam_a") == F.col("fam_b"))
        best = met.withColumns({"rank": rank, "even": even}).groupBy("fam_a", "fam_b").agg(
            F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"), F.min(F.when(F.col("even") | F.col("up_a"), F.col("rank"))).alias("rank_a"),
            F.min(F.when(F.col("even") | ~F.col("up_a"), F.col("rank"))).alias("rank_b"), F.max(F.col("u") == -1).alias("near"),
        )
        return best.where("(rank_a is not null or rank_b is not null) and (fam_a != fam_b or size_a > 1)")

    @staticmethod
    def _n_met(near: DataFrame, ups: dict[int, list[int]]) -> int:
        """The number of rows in which two families meet at an ancestor, from how many are how far below each."""
        if not ups:
            return 0
        gens = sorted({*ups, *(u for us in ups.values() for u in us)})
        below = near.groupBy("anc").agg(*(F.count_if(F.col("gen") == k).alias(f"g{k}") for k in gens))
        return below.agg(F.sum(sum(F.col(f"g{u}") * F.col(f"g{d}") for d, us in ups.items() for u in us))).first()[0] or 0

    def _far(self, df: DataFrame, f: str, g: str) -> DataFrame:
        """``df`` with ``far``, the rank between families f and g; only marked pairs of families are read."""
        kin = self.families.where("near").select("fam_a", "fam_b", F.least("rank_a", "rank_b").alias("far"))
        df = df.withColumn("fam_a", F.when(F.col(g).isNotNull(), F.least(f, g))).withColumn("fam_b", F.when(F.col(f).isNotNull(), F.greatest(f, g)))
        return df.join(kin, ["fam_a", "fam_b"], "left").drop("fam_a", "fam_b")

    def _closer(self) -> tuple[DataFrame, DataFrame | None]:
        """Lines (fam, anc, size, rank, far) and, with twins, what they change (lo, hi, rank, far, w): a link counts, and a
        line between the two doesn't (w = -1)."""
        lines = self._far(self.line, "fam", "g")
        if self.linked is None:
            return lines, None
        links = self._far(self.linked, "f", "g").withColumns({"rank": F.lit(0), "w": F.lit(1)}).select("lo", "hi", "rank", "far", "w")
        both = self.linked.select("lo", "hi", F.col("f").alias("fam"), F.col("hi").alias("anc")).unionByName(self.linked.select("lo", "hi", F.col("g").alias("fam"), F.col("lo").alias("anc")))
        lost = both.join(lines, ["fam", "anc"]).select("lo", "hi", "rank", "far", F.lit(-1).alias("w"))
        return lines, links.unionByName(lost)

    def _sized(self) -> DataFrame:
        """Family pairs with both sizes, the number of pairs of persons and the rank."""
        n = F.when(F.col("fam_a") == F.col("fam_b"), F.col("size_a") * (F.col("size_a") - 1) / 2).otherwise(F.col("size_a") * F.col("size_b")).cast("long")
        return self.families.select("fam_a", "fam_b", "size_a", "size_b", n.alias("n"), F.least("rank_a", "rank_b").alias("rank"))

    def pairs(self) -> DataFrame:
        """id1, id2, code: the junior first, or the smaller id where both are.

        Only pairs of families with a line or a twin link between them can hold a pair of persons twice.
        """
        few = self.members.withColumn("part", F.floor(F.row_number().over(W.partitionBy("fam").orderBy("id")) / 64)).groupBy("fam", "part").agg(F.collect_list("id").alias("ids"))
        few = stored(few.select("fam", "ids"), "member-lists")  # lists of at most 64

        def spread(families: DataFrame) -> DataFrame:
            got = families.join(few.select(F.col("fam").alias("fam_a"), F.col("ids").alias("as")), "fam_a").join(few.select(F.col("fam").alias("fam_b"), F.col("ids").alias("bs")), "fam_b")
            got = got.withColumn("a", F.explode("as")).withColumn("b", F.explode("bs")).where("fam_a != fam_b or a < b")
            ra, rb = F.coalesce("rank_a", F.lit(len(CODES))), F.coalesce("rank_b", F.lit(len(CODES)))
            i = F.when(ra < rb, F.col("a")).when(rb < ra, F.col("b")).otherwise(F.least("a", "b"))
            j = F.when(ra < rb, F.col("b")).when(rb < ra, F.col("a")).otherwise(F.greatest("a", "b"))
            return got.select(F.least(ra, rb).alias("rank"), i.alias("i"), j.alias("j"))

        closer = self.line.join(self.members.select("id", "fam"), "fam").select("rank", F.col("id").alias("i"), F.col("anc").alias("j"))
        if self.linked is not None:
            closer = closer.unionByName(self.linked.select(F.lit(0).alias("rank"), F.col("lo").alias("i"), F.col("hi").alias("j")))
        twice = spread(self.families.where("near")).unionByName(closer).groupBy(F.least("i", "j"), F.greatest("i", "j")).agg(F.min(F.struct("rank", "i", "j")).alias("best"))
        once = spread(self.families.where("not near"))
        return once.unionByName(twice.select("best.*")).select(F.col("i").alias("id1"), F.col("j").alias("id2"), _code(F.col("rank")).alias("code"))

    def counts(self) -> DataFrame:
        """code and number of pairs, without a list of pairs."""
        lines, changed = self._closer()
        near = lines.select("rank", "far", F.col("size").alias("n"))
        if changed is not None:
            near = near.unionByName(changed.select("rank", "far", F.col("w").cast("long").alias("n")))
        near = near.where("far is null or rank < far").groupBy("rank", "far").agg(F.sum("n").alias("n"))
        near = near.select(F.explode(F.array(F.struct("rank", "n"), F.struct(F.col("far").alias("rank"), (-F.col("n")).alias("n")))).alias("c")).select("c.*").where("rank is not null")
        n = self._sized().groupBy("rank").agg(F.sum("n").alias("n")).unionByName(near)
        return n.groupBy("rank").agg(F.sum("n").alias("n")).where("n > 0").select(_code(F.col("rank")).alias("code"), "n")

    def burden(self) -> DataFrame:
        """Per person: relatives by degree 1 to 5 and the closest degree."""
        new, old = _degree(F.col("rank")), _degree(F.col("far"))

        def tally(df: DataFrame, key: str, n: Column, *degrees: tuple[Column, int]) -> DataFrame:
            of = lambda k: sum((F.when(c == k, sign * n).otherwise(0) for c, sign in degrees), F.lit(0))
            return df.groupBy(key).agg(*(F.sum(of(k)).alias(f"d{k}") for k in range(6)))

        s = self._sized()
        sides = s.select(F.col("fam_a").alias("fam"), "rank", F.when(F.col("fam_a") == F.col("fam_b"), F.col("size_b") - 1).otherwise(F.col("size_b")).alias("n"))
        sides = sides.unionByName(s.where("fam_a != fam_b").select(F.col("fam_b").alias("fam"), "rank", F.col("size_a").alias("n")))
        lines, changed = self._closer()
        lines = lines.where("far is null or rank < far")
        by = tally(sides, "fam", F.col("n"), (new, 1)).unionByName(tally(lines, "fam", F.lit(1), (new, 1), (old, -1)))
        by = by.groupBy("fam").agg(*(F.sum(f"d{k}").alias(f"d{k}") for k in range(6)))
        own = tally(lines, "anc", F.col("size"), (new, 1), (old, -1)).withColumnRenamed("anc", "id")
        if changed is not None:
            both = changed.where("far is null or rank < far").select(F.explode(F.array("lo", "hi")).alias("id"), "rank", "far", "w")
            own = own.unionByName(tally(both, "id", F.col("w"), (new, 1), (old, -1)))
        own = own.groupBy("id").agg(*(F.sum(f"d{k}").alias(f"e{k}") for k in range(6)))
        rows = self.ped.select("id").join(self.members.select("id", "fam"), "id", "left").join(own, "id", "left").join(by, "fam", "left")
        n = [F.coalesce(f"d{k}", F.lit(0)) + F.coalesce(f"e{k}", F.lit(0)) for k in range(6)]
        some = F.lit(False)
        for k in range(6):
            some = some | (n[k] > 0)
        closest = F.coalesce(*(F.when(n[k] > 0, k) for k in range(6)))
        return rows.select("id", *(F.when(F.lit(k <= self.max_degree) & some, n[k]).otherwise(F.lit(0) if k <= self.max_degree else F.lit(None)).cast("long").alias(f"degree_{k}") for k in range(1, 6)), closest.alias("closest_degree"))

    def density(self, depth: DataFrame) -> DataFrame:
        """Per depth: persons, related pairs within it, and their share of all pairs; members of a family share their depth,
        and a line never stays within one."""
        at = lambda k, d: depth.select(F.col("id").alias(k), F.col("depth").alias(d))
        inside = self._sized().join(at("fam_a", "d1"), "fam_a").join(at("fam_b", "d2"), "fam_b").where("d1 = d2").groupBy("d1").agg(F.sum("n").alias("n"))
        if self.linked is not None:
            links = self._far(self.linked, "f", "g").where("far is null")
            inside = inside.unionByName(links.join(at("lo", "d1"), "lo").join(at("hi", "d2"), "hi").where("d1 = d2").groupBy("d1").agg(F.count("*").alias("n")))
        return _density(depth, inside.groupBy(F.col("d1").alias("depth")).agg(F.sum("n").alias("n_pairs")))


def _code(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(c[0]) for c in CODES)), rank + 1)


def _degree(rank: Column) -> Column:
    return F.get(F.array(*(F.lit(c[1]) for c in CODES)), rank)


def _density(depth: DataFrame, inside: DataFrame) -> DataFrame:
    size = depth.groupBy("depth").agg(F.count("*").alias("n"))
    n = F.coalesce("n_pairs", F.lit(0))
    return size.join(inside, "depth", "left").select("depth", "n", n.alias("n_pairs"), F.when(F.col("n") > 1, n / (F.col("n") * (F.col("n") - 1) / 2)).alias("density"))


def relationship_pairs(ped: DataFrame, paths: DataFrame, max_degree: int = 5, twins: DataFrame | None = None) -> DataFrame:
    """id1, id2, code of every related pair: the junior (more steps up) first, or the smaller id where both go as far.

    ``twins`` holds linked pairs (id1, id2).
    """
    return Kin(ped, paths, max_degree, twins).pairs()


def relationship_counts(pairs: DataFrame, max_degree: int = 5) -> dict[str, int | None]:
    """Counts by code with ``PO``, and ``by_degree``; codes beyond ``max_degree`` are None, not 0."""
    got = {r["code"]: r["count"] for r in pairs.groupBy("code").count().collect()}  # at most 23 rows
    out: dict = {c: got.get(c, 0) if DEGREE[c] <= max_degree else None for c in ORDER}
    out["PO"] = out["MO"] + out["FO"]
    out["by_degree"] = {k: sum(out[c] for c in ORDER if DEGREE[c] == k) if k <= max_degree else None for k in range(6)}
    return out


def relationship_burden(ped: DataFrame, pairs: DataFrame, max_degree: int = 5) -> DataFrame:
    """Per person: relatives by degree 1 to 5 and the closest degree; the pairs count for both members."""
    degree = F.element_at(F.create_map(*(F.lit(x) for c in CODES for x in (c[0], c[1]))), F.col("code"))
    sides = pairs.select(F.explode(F.array("id1", "id2")).alias("id"), degree.alias("degree"))
    by = sides.groupBy("id").agg(*(F.count_if(F.col("degree") == k).alias(f"degree_{k}") for k in range(1, 6)), F.min("degree").alias("closest_degree"))
    out = ped.select("id").join(by, "id", "left")
    return out.select("id", *((F.coalesce(f"degree_{k}", F.lit(0)) if k <= max_degree else F.lit(None).cast("long")).alias(f"degree_{k}") for k in range(1, 6)), "closest_degree")


def related_density(pairs: DataFrame, depth: DataFrame) -> DataFrame:
    """Per depth: persons, related pairs within it, and their share of all pairs."""
    one, two = (depth.select(F.col("id").alias(k), F.col("depth").alias(f"d{k[-1]}")) for k in ("id1", "id2"))
    inside = pairs.join(one, "id1").join(two, "id2").where("d1 = d2").groupBy(F.col("d1").alias("depth")).agg(F.count("*").alias("n_pairs"))
    return _density(depth, inside)

"""Mixing sources to target shares of the total size, with a cap on how often a record may be used.

Sizes are summed by source first (partial aggregation); the plan is made over the listed sources, whose number the
targets table bounds. A source takes part with whole repetitions of all its records and a seeded fraction of one
more: records are ordered by a seeded hash, and the hash where the fraction ends is found on a histogram of hashes,
so no record is sorted or collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the hash histogram per source; the mix misses a share by at most one cell of that source.
CELLS = 2048


@dataclass
class Share:
    """What a source gets: ``size`` of the mix, in repetitions ``whole`` and a ``fraction`` of one more."""

    source: str
    target: float
    available: int
    cap: int
    size: float = 0.0
    clamped: bool = False
    reachable: bool = True

    @property
    def repetitions(self) -> float:
        return min(float(self.cap), self.size / self.available) if self.available else 0.0


def water_fill(targets: list[tuple[str, float, int]], available: dict[str, int], total: float | None = None) -> list[Share]:
    """Shares of a mix of ``total`` (default: all that the listed sources have), by capped water-filling.

    Sources that can't reach their share at their cap are clamped there; what they leave is spread over the others
    in proportion to their targets, again and again until no more source is clamped. If all are clamped the mix is
    smaller than asked for. ``reachable`` tells whether the first, undisturbed target was within the cap.
    """
    shares = [Share(s, float(t or 0), int(available.get(s, 0)), max(0, int(c or 0))) for s, t, c in targets]
    total = float(sum(s.available for s in shares)) if total is None else float(total)
    for s in shares:
        s.reachable = s.available * s.cap >= s.target * total
    open_ = list(shares)
    room = total
    while open_:
        weight = sum(s.target for s in open_)
        over = [s for s in open_ if weight > 0 and s.target / weight * room > s.available * s.cap]
        if not over:
            for s in open_:
                s.size = s.target / weight * room if weight > 0 else 0.0
            break
        for s in over:
            s.size, s.clamped = float(s.available * s.cap), True
        room -= sum(s.size for s in over)
        open_ = [s for s in open_ if not s.clamped]
    return shares


def mix_plan(sized: DataFrame, source: str, size: str, targets: DataFrame, total: float | None = None) -> list[Share]:
    """The shares for a table of sized records. Records without a source, or of one not listed, aren't in the mix."""
    rows = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").where("source is not null").collect()]
    rows = list({r[0]: r for r in sorted(rows)}.values())
    listed = F.broadcast(targets.select(F.col("source").alias(source)).where(F.col(source).isNotNull()).distinct())
    sums = sized.join(listed, source, "left_semi").groupBy(source).agg(F.sum(size).alias("n"))
    return water_fill(rows, {r[source]: int(r["n"] or 0) for r in sums.collect()}, total)


def _hashed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return df.withColumn("_h", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 32)))


def mixed(sized: DataFrame, id_col: str, source: str, size: str, shares: list[Share], seed: int = 17) -> DataFrame:
    """(id, source, size, copies) of the records in the mix: ``copies`` is at least 1 and at most the source's cap.

    Every record of a source is used floor(repetitions) times; of the rest a seeded part is used once more, cut at
    the histogram cell that brings the source nearest to its size. The same seed gives the same mix.
    """
    spark = sized.sparkSession
    whole = {s.source: int(s.repetitions) for s in shares}
    rows = [(s.source, whole[s.source], float(s.size - whole[s.source] * s.available)) for s in shares]
    table = F.broadcast(spark.createDataFrame(rows, f"`{source}` string, _whole int, _rest double"))
    df = _hashed(sized.select(id_col, source, size), id_col, seed).join(table, source)
    cell = F.floor(F.col("_h") * CELLS / (1 << 32)).cast("int")
    cells = df.where(F.col("_rest") > 0).groupBy(source, cell.alias("_cell")).agg(F.sum(size).alias("n")).collect()  # at most CELLS per listed source
    by_source: dict[str, dict[int, int]] = {}
    for r in cells:
        by_source.setdefault(r[source], {})[r["_cell"]] = r["n"] or 0
    cuts = []
    for name, _, rest in rows:
        reached, cut = 0.0, 0
        for c in range(CELLS):
            n = by_source.get(name, {}).get(c, 0)
            if rest <= 0 or reached + n / 2 > rest:
                break
            reached, cut = reached + n, c + 1
        cuts.append((name, cut))
    cut_table = F.broadcast(spark.createDataFrame(cuts, f"`{source}` string, _cut int"))
    df = df.join(cut_table, source).withColumn("copies", F.col("_whole") + (cell < F.col("_cut")).cast("int"))
    return df.where(F.col("copies") > 0).select(id_col, source, size, "copies")


def mix_report(mix: DataFrame, source: str, size: str, shares: list[Share]) -> DataFrame:
    """A row per listed source: target share, tokens available, asked for and used, actual share, records, reachable."""
    spark = mix.sparkSession
    rows = [(s.source, s.target, s.available, s.cap, s.size, s.reachable, s.clamped) for s in shares]
    base = spark.createDataFrame(rows, "source string, target_share double, available bigint, max_repeats int, planned double, reachable boolean, clamped boolean")
    used = mix.groupBy(F.col(source).alias("source")).agg(F.sum(F.col(size) * F.col("copies")).alias("used"), F.count(F.lit(1)).alias("records"), F.max("copies").alias("most_copies"))
    out = base.join(used, "source", "left").na.fill(0, ["used", "records", "most_copies"])
    total = used.agg(F.coalesce(F.sum("used"), F.lit(0))).first()[0]
    return out.withColumn("actual_share", F.col("used") / F.lit(float(total)) if total else F.lit(0.0))

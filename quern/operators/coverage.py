"""Per-base analytics by difference arrays: two rows per read or span, whatever its length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def depth_runs(spans: DataFrame, seq: str = "seq_id", start: str = "start", end: str = "end", weight: str | None = None) -> DataFrame:
    """Runs of equal coverage: ``seq_id, start, end`` (excluded), ``depth``.

    Adds the weight at each start and takes it off at each end; the running sum
    between two changes is the coverage there.
    """
    w = F.col(weight) if weight else F.lit(1).cast("long")
    change = spans.select(F.col(seq).alias("seq_id"), F.inline(F.array(F.struct(F.col(start).alias("at"), w.alias("d")), F.struct(F.col(end).alias("at"), (-w).alias("d")))))
    change = change.groupBy("seq_id", "at").agg(F.sum("d").alias("d"))
    by = Window.partitionBy("seq_id").orderBy("at")
    runs = change.select("seq_id", F.col("at").alias("start"), F.lead("at").over(by).alias("end"), F.sum("d").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"))
    return runs.filter("end IS NOT NULL")


def insert_runs(pairs: DataFrame) -> DataFrame:
    """Runs of equal physical coverage by pairs: ``seq_id, start, end`` (excluded), ``depth``, ``mean_insert``.

    A pair ``seq_id, start, end`` covers all bases between its outer ends; the mean
    is of the lengths of those that cover a base, null where none does. One pass
    over differences of counts and of lengths.
    """
    length = (F.col("end") - F.col("start")).cast("long")
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(1).cast("long").alias("d"), length.alias("x")), F.struct(F.col("end").alias("at"), F.lit(-1).cast("long").alias("d"), (-length).alias("x")))
    change = pairs.select("seq_id", F.inline(ends)).groupBy("seq_id", "at").agg(F.sum("d").alias("d"), F.sum("x").alias("x"))
    by = Window.partitionBy("seq_id").orderBy("at")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    runs = change.select("seq_id", F.col("at").alias("start"), F.lead("at").over(by).alias("end"), F.sum("d").over(upto).alias("depth"), F.sum("x").over(upto).alias("_x"))
    return runs.filter("end IS NOT NULL").withColumn("mean_insert", F.when(F.col("depth") > 0, F.col("_x") / F.col("depth"))).drop("_x")


def inside(spans: DataFrame, catalog: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Spans that lie on their reference whole."""
    return spans.join(catalog.select("seq_id", "seq_len"), "seq_id").filter((F.col(start) >= 1) & (F.col(end) - 1 <= F.col("seq_len")))


def depth_stats(runs: DataFrame, catalog: DataFrame, margin: int = 0) -> DataFrame:
    """Per reference longer than two margins: mean, deviation, least and most coverage between them, and the share of bases without any."""
    lo, hi = F.lit(1 + margin), F.col("seq_len") - margin
    rows = runs.join(catalog.select("seq_id", "seq_len"), "seq_id").filter(F.col("seq_len") > 2 * margin)
    n = F.greatest(F.least("end", hi + 1) - F.greatest("start", lo), F.lit(0))
    whole = F.greatest(F.least("end", F.col("seq_len") + 1) - F.greatest("start", F.lit(1)), F.lit(0))
    agg = rows.withColumn("n", n).withColumn("whole", whole).groupBy("seq_id", "seq_len").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("depth")).alias("s"),
        F.sum(F.col("n") * F.col("depth") * F.col("depth")).alias("q"),
        F.min(F.when(F.col("n") > 0, F.col("depth"))).alias("lo"),
        F.max(F.when(F.col("n") > 0, F.col("depth"))).alias("hi"),
        F.sum(F.when(F.col("depth") > 0, F.col("whole")).otherwise(0)).alias("covered"),
    )
    size = F.col("seq_len") - 2 * margin
    mean = F.col("s") / size
    return agg.select(
        "seq_id",
        mean.alias("adj_cov"),
        F.sqrt(F.greatest(F.col("q") / size - mean * mean, F.lit(0.0))).alias("adj_cov_stddev"),
        F.when(F.col("n") < size, F.lit(0)).otherwise(F.col("lo")).cast("long").alias("adj_cov_min"),
        F.coalesce("hi", F.lit(0)).cast("long").alias("adj_cov_max"),
        (1 - F.col("covered") / F.col("seq_len")).alias("pct_uncov"),
    )


def mean_coverage(runs: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: coverage of all references, weighted by their length, and twice that, over which a duplication is collapsed."""
    total = runs.agg(F.sum((F.col("end") - F.col("start")) * F.col("depth")).alias("bases"))
    mean = F.col("bases") / catalog.agg(F.sum("seq_len")).scalar()
    return total.select(mean.alias("mean"), (2 * mean).alias("dup_threshold"))


def _best_segments(score: Column, least: float, spans: Column) -> Column:
    """Maximal-sum segments of a score over runs; the sum starts anew when it falls below nothing."""
    none = F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(0.0).alias("top"), F.lit(0.0).alias("sum"), F.array().cast("array<struct<start:long,end:long,score:double>>").alias("out"))

    def close(acc: Column) -> Column:
        return F.when(acc["top"] > least, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"), acc["top"].alias("score"))))).otherwise(acc["out"])

    def step(acc: Column, r: Column) -> Column:
        total = acc["sum"] + r["gain"]
        opened = F.coalesce(acc["start"], r["start"])
        new_top = total > acc["top"]
        going = F.struct(opened.alias("start"), F.when(new_top, r["end"]).otherwise(acc["end"]).alias("end"), F.greatest(acc["top"], total).alias("top"), total.alias("sum"), acc["out"].alias("out"))
        ended = F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(0.0).alias("top"), F.lit(0.0).alias("sum"), close(acc).alias("out"))
        return F.when(total <= 0, ended).otherwise(going)

    return F.aggregate(spans, none, step, close)


def segments(runs: DataFrame, high: Column, gain: float = 1.0, loss: float = 1.0, least: float = 60.0) -> DataFrame:
    """Stretches of a reference that are mostly ``high``: ``seq_id, start, end, score``.

    Every base scores ``gain`` where the run is high and ``-loss`` elsewhere; a
    stretch is reported if its best sum is over ``least``. One row per run, not per
    base; a reference's runs are folded in order inside one row.
    """
    n = (F.col("end") - F.col("start")).cast("double")
    scored = runs.withColumn("gain", F.when(high, n * gain).otherwise(-n * loss))
    rows = scored.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "gain"))).alias("runs"))
    return rows.select("seq_id", F.inline(_best_segments(F.col("runs"), least, F.col("runs"))))


def islands(runs: DataFrame, test: Column, least: int) -> DataFrame:
    """Unbroken stretches of at least ``least`` bases that pass the test: ``seq_id, start, end``."""
    marked = runs.withColumn("_ok", F.coalesce(test, F.lit(False)))
    by = Window.partitionBy("seq_id").orderBy("start")
    new = F.when(F.col("_ok") & F.coalesce(F.lag("_ok").over(by) & (F.lag("end").over(by) == F.col("start")), F.lit(False)), 0).otherwise(1)
    grouped = marked.withColumn("_new", new).withColumn("_g", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).filter("_ok")
    return grouped.groupBy("seq_id", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).filter(F.col("end") - F.col("start") >= least).drop("_g")


def end_peaks(runs: DataFrame, step: int = 75) -> DataFrame:
    """From either end of each reference, the first coverage that the next ``step`` bases do not exceed."""
    by = Window.partitionBy("seq_id").orderBy("start").rangeBetween(0, step)
    back = Window.partitionBy("seq_id").orderBy(F.col("end").desc()).rangeBetween(0, step)
    at = runs.withColumn("ahead", F.max("depth").over(by)).withColumn("behind", F.max("depth").over(back))
    first = at.filter("depth >= ahead").groupBy("seq_id").agg(F.min_by("depth", "start").alias("front_peak"))
    last = at.filter("depth >= behind").groupBy("seq_id").agg(F.max_by("depth", "end").alias("back_peak"))
    return first.join(last, "seq_id")


def moving_gc(bases: DataFrame, window: int, circular: bool = False) -> DataFrame:
    """Share of G and C in a centred window of ``seq_id, pos, base``; edges take the nearest whole window's.

    A window that is not shorter than the sequence gives the mean of all. With
    ``circular`` the window wraps.
    """
    half = window // 2
    rows = bases.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("seq_id"))).withColumn("gc", F.col("base").isin("G", "C").cast("double"))
    by = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(-half, half)
    whole = Window.partitionBy("seq_id")
    if circular:
        wrapped = rows.withColumn("own", F.lit(True)).unionByName(rows.filter(F.col("pos") <= half).withColumn("pos", F.col("pos") + F.col("n")).withColumn("own", F.lit(False))).unionByName(
            rows.filter(F.col("pos") > F.col("n") - half).withColumn("pos", F.col("pos") - F.col("n")).withColumn("own", F.lit(False))
        )
        return wrapped.withColumn("mean_gc", F.avg("gc").over(by)).filter("own").select("seq_id", "pos", "mean_gc")
    moved = rows.withColumn("m", F.when((F.col("pos") > half) & (F.col("pos") <= F.col("n") - half), F.avg("gc").over(by)))
    edges = moved.withColumn("lo", F.min_by("m", F.when(F.col("m").isNotNull(), F.col("pos"))).over(whole)).withColumn("hi", F.max_by("m", F.when(F.col("m").isNotNull(), F.col("pos"))).over(whole))
    value = F.coalesce("m", F.when(F.col("pos") <= half, F.col("lo")).otherwise(F.col("hi")), F.avg("gc").over(whole))
    return edges.withColumn("mean_gc", value).select("seq_id", "pos", "mean_gc")


def problem_report(problems: DataFrame) -> DataFrame:
    """Problems by type: how many, on how many references, and their bases."""
    return problems.groupBy("type").agg(F.count(F.lit(1)).alias("problems"), F.countDistinct("seq_id").alias("refs"), F.sum(F.col("end") - F.col("start")).alias("bases"))


def problem_counts(nodes: DataFrame) -> DataFrame:
    """The same of nodes that hold their problems as ``contig_problems array<struct<start, end, type>>``."""
    return problem_report(nodes.select(F.col("id").alias("seq_id"), F.explode("contig_problems").alias("p")).select("seq_id", "p.*"))


def problem_detail(problems: DataFrame, runs: DataFrame) -> DataFrame:
    """Each problem with the least covered place in its span, and the coverage there."""
    inside = problems.join(runs.select("seq_id", F.col("start").alias("a"), F.col("end").alias("b"), "depth"), "seq_id").filter((F.col("a") < F.col("end")) & (F.col("b") > F.col("start")))
    least = F.min(F.struct("depth", F.greatest("a", "start").alias("at")))
    return inside.groupBy("seq_id", "start", "end", "type").agg(least.alias("x")).select("seq_id", "start", "end", "type", F.col("x.at").alias("at"), F.col("x.depth").alias("depth"))


#: Penalties of candidate codes, by the number of bases that a code stands for.
MISMATCH, MATCH = {1: 1.0, 2: 1.25, 3: 1.25, 4: 1.25}, {1: 0.0, 2: 0.334, 3: 0.75, 4: 0.99}


def consensus(counts: DataFrame, ambig_tol: float = 0.2) -> DataFrame:
    """The code with the least penalty at each position of ``seq_id, pos, a, c, g, t`` (weights); uncovered is N.

    A base costs a code that includes it the code's ambiguity, scaled by the
    tolerance, and one that does not a mismatch. Equal penalties go to the code
    with the lowest bits.
    """
    from quern.functions.sequence import IUPAC_BITS

    scale = 0.5 + 2.5 * ambig_tol
    codes = sorted(IUPAC_BITS, key=IUPAC_BITS.get)
    total = F.col("a") + F.col("c") + F.col("g") + F.col("t")

    def cost(code: str) -> Column:
        bits = IUPAC_BITS[code]
        n = bits.bit_count()
        return sum((F.col(b) * (min(1.0, MATCH[n] * scale) if bits & (1 << k) else MISMATCH[n]) for k, b in enumerate("acgt")), F.lit(0.0))

    best = F.array_min(F.array(*[F.struct(F.round(cost(c), 9).alias("p"), F.lit(IUPAC_BITS[c]).alias("b"), F.lit(c).alias("code")) for c in codes]))
    return counts.select("seq_id", "pos", F.when(total > 0, best["code"]).otherwise("N").alias("base"))


def _color_path(counts, ambig_tol: float) -> str:  # noqa: ANN001
    """The codes that colours between neighbouring positions cost the least, found from right to left.

    ``counts`` has a row of four colour weights for each step between positions. A
    step from code y to z costs a colour z's ambiguity if the colour takes one of
    y's bases to one of z's, and a mismatch otherwise; y's own ambiguity is counted
    on the step before. Equal costs go to the lowest code; a position that no
    colour touches is N.
    """
    import numpy as np

    from quern.functions.sequence import IUPAC_BITS

    names = sorted(IUPAC_BITS, key=IUPAC_BITS.get)
    bits = [IUPAC_BITS[c] for c in names]
    scale = 0.5 + 2.5 * ambig_tol
    through = lambda y, c: sum(1 << ((k ^ c)) for k in range(4) if y & (1 << k))
    price = np.array([[[min(1.0, MATCH[z.bit_count()] * scale) if through(y, c) & z else MISMATCH[z.bit_count()] for z in bits] for y in bits] for c in range(4)])
    own = np.array([min(1.0, MATCH[y.bit_count()] * scale) for y in bits])
    counts = np.asarray(counts, dtype=float).reshape(-1, 4)
    n = len(counts)
    step = np.tensordot(counts, price, axes=(1, 0)) if n else np.zeros((0, 15, 15))
    weight = counts.sum(axis=1)
    for k in np.flatnonzero((weight[:-1] == 0) & (weight[1:] > 0)):
        step[k] += own[None, :] * weight[k + 1]  # a run of colours starts anew here, and so does its first code's cost
    ahead, choice = np.zeros(15), np.zeros((n, 15), dtype=int)
    for k in range(n - 1, -1, -1):
        total = np.round(step[k] + ahead[None, :], 9)
        choice[k] = total.argmin(axis=1)
        ahead = total.min(axis=1)
    first = int(np.round(ahead + own * (counts[0].sum() if n else 0), 9).argmin())
    path = [first]
    for k in range(n):
        path.append(int(choice[k][path[-1]]))
    touched = counts.sum(axis=1) > 0
    covered = np.concatenate([touched, [False]]) | np.concatenate([[False], touched])
    return "".join(names[p] if covered[k] else "N" for k, p in enumerate(path))


def color_consensus(counts: DataFrame, catalog: DataFrame, ambig_tol: float = 0.2) -> DataFrame:
    """``seq_id, seq`` from colour weights ``seq_id, pos, c0, c1, c2, c3`` of the steps from ``pos`` to the next base.

    A reference's steps depend on each other from end to end, so each is one group.
    """
    rows = counts.join(catalog.select("seq_id", "seq_len"), "seq_id")
    kind = dict(counts.dtypes)["seq_id"]

    def run(rows):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        steps = np.zeros((max(int(rows["seq_len"].iloc[0]) - 1, 0), 4))
        own = rows[(rows["pos"] >= 1) & (rows["pos"] < rows["seq_len"])]
        np.add.at(steps, own["pos"].to_numpy() - 1, own[["c0", "c1", "c2", "c3"]].to_numpy(dtype=float))
        return pd.DataFrame([(rows["seq_id"].iloc[0], _color_path(steps, ambig_tol))], columns=["seq_id", "seq"])

    return rows.groupBy("seq_id").applyInPandas(run, f"seq_id {kind}, seq string")

"""Thermodynamic series over replicas. Tables: thermo(sim, step, row_ord, parameter, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import padded_range
from ..sources.store import materialize

#: Fixed value: the parameters shown first, in this order.
PREFERRED = ("Temp", "PotEng", "KinEng", "Press", "Volume", "Density")


def select_thermo(thermo: DataFrame, parameter: str, sims: list[int] | None = None) -> DataFrame:
    own = thermo.where(F.col("parameter") == parameter)
    own = own.where(F.col("sim").isin(*sims)) if sims is not None else own
    return own.select("sim", "step", "value")


def align_thermo(thermo: DataFrame) -> DataFrame:
    """(parameter, step, sim, value) at the steps that every simulation with the parameter has.

    A step that repeats within simulations stands for every combination of their rows, as in a chain of
    inner joins: each value then counts as often as the other simulations' rows multiply.
    """
    each = thermo.groupBy("parameter", "step", "sim").agg(F.count("*").alias("n"), F.collect_list("value").alias("v"))
    sims = thermo.select("parameter", "sim").distinct().groupBy("parameter").agg(F.count("*").alias("n_sims"))
    steps = each.groupBy("parameter", "step").agg(F.count("*").alias("have"), F.product(F.col("n").cast("double")).cast("bigint").alias("times"))
    whole = steps.join(F.broadcast(sims), "parameter").where("have = n_sims").select("parameter", "step", "times")
    own = each.join(whole, ["parameter", "step"])
    return own.select("parameter", "step", "sim", F.explode("v").alias("value"), (F.col("times") / F.col("n")).cast("bigint").alias("times"))


def aggregate_thermo_all(thermo: DataFrame) -> DataFrame:
    """(parameter, step, mean, std) over simulations: NaN is skipped, the sample deviation of one value is 0.

    With repeated steps there is a row for each combination of rows, as a chain of inner joins gives: partial sums of
    the combinations so far are joined with the next simulation's rows, so that no combination is held as a list.
    """
    numbered = thermo.where("step IS NOT NULL").select("parameter", "step", "sim", F.nanvl("value", F.lit(None)).alias("value"))
    agg = numbered.groupBy("parameter", "step").agg(F.countDistinct("sim").alias("have"), F.count("*").alias("rows"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    sims = numbered.select("parameter", "sim").distinct()
    held = materialize(agg.join(F.broadcast(sims.groupBy("parameter").agg(F.count("*").alias("n_sims"))), "parameter").where("have = n_sims"), "steps")
    single = held.where("rows = n_sims").select("parameter", "step", "mean", "std")
    twice = held.where("rows > n_sims").select("parameter", "step")
    if twice.isEmpty():
        return single
    again = materialize(numbered.join(twice, ["parameter", "step"], "left_semi"), "repeated")
    found = None
    # one value at a time, centred on the step's own mean: count, sum and sum of squares of a combination
    centred = again.join(held.select("parameter", "step", F.coalesce("mean", F.lit(0.0)).alias("m")), ["parameter", "step"]).withColumn("d", F.col("value") - F.col("m"))
    part = centred.select("parameter", "step", "sim", "m", F.col("d").isNotNull().cast("int").alias("k"), F.coalesce("d", F.lit(0.0)).alias("s"), F.coalesce(F.col("d") * F.col("d"), F.lit(0.0)).alias("q"))
    for r in again.select("sim").distinct().orderBy("sim").collect():
        own = part.where(F.col("sim") == r.sim).drop("sim")
        if found is None:
            found = own
            continue
        # a parameter that this simulation lacks keeps its combinations
        other = own.select("parameter", "step", *(F.col(c).alias(f"o_{c}") for c in ("m", "k", "s", "q")))
        both = found.join(other, ["parameter", "step"], "full")
        add = lambda c: F.coalesce(c, F.lit(0)) + F.coalesce(f"o_{c}", F.lit(0))
        found = both.select("parameter", "step", F.coalesce("m", "o_m").alias("m"), *(add(c).alias(c) for c in ("k", "s", "q")))
    mean = F.when(F.col("k") > 0, F.col("m") + F.col("s") / F.col("k"))
    spread = F.when(F.col("k") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("k")) / (F.col("k") - 1)))).otherwise(0.0)
    return single.unionByName(found.select("parameter", "step", mean.alias("mean"), spread.alias("std")))


def aggregate_thermo(thermo: DataFrame, parameter: str) -> DataFrame:
    """(step, mean, std) of one parameter; an error if no simulation has it."""
    own = thermo.where(F.col("parameter") == parameter)
    if own.isEmpty():
        raise LookupError(f"no simulation has {parameter}")
    return aggregate_thermo_all(own).drop("parameter")


def thermo_band(aggregated: DataFrame) -> DataFrame:
    return aggregated.withColumns({"lower": F.col("mean") - F.col("std"), "upper": F.col("mean") + F.col("std")})


def thermo_bounds(thermo: DataFrame) -> DataFrame:
    """(parameter, step_min, step_max, y_min, y_max), NaN left out."""
    value, step = F.nanvl("value", F.lit(None)), F.nanvl("step", F.lit(None))
    return thermo.groupBy("parameter").agg(F.min(step).alias("step_min"), F.max(step).alias("step_max"), F.min(value).alias("y_min"), F.max(value).alias("y_max"))


def thermo_parameters(thermo: DataFrame) -> DataFrame:
    """(parameter, pos): all names in order, or only the preferred ones in theirs if any is there."""
    names = thermo.select("parameter").distinct()
    preferred = thermo.sparkSession.createDataFrame(list(enumerate(PREFERRED)), "place int, parameter string")
    joined = names.join(F.broadcast(preferred), "parameter", "left")
    any_ = joined.agg(F.coalesce(F.max(F.col("place").isNotNull()), F.lit(False)).alias("any"))
    kept = joined.crossJoin(F.broadcast(any_)).where("NOT any OR place IS NOT NULL")
    rank = F.sort_array(F.collect_list(F.struct(F.coalesce("place", F.lit(0)), "parameter")))
    return kept.agg(rank.alias("r")).select(F.posexplode("r").alias("pos", "x")).select(F.col("x.parameter").alias("parameter"), "pos")


def filter_range(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    a, b = padded_range(F.lit(float(lo)), F.lit(float(hi)))
    return df.where(F.col(column).between(a, b))


def series_label(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds label: the simulation's own if it is not blank, else 'Simulation i'."""
    given = F.when(F.trim("given") != "", F.trim("given"))
    return df.join(F.broadcast(labels.select("sim", F.col("label").alias("given"))), "sim", "left").withColumn("label", F.coalesce(given, F.concat(F.lit("Simulation "), "sim"))).drop("given")

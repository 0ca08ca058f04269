"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units by thermo parameter, masses and van der Waals radii (angstrom) by element, display diameters.
THERMO_UNITS = {"PotEng": "kcal/mol", "KinEng": "kcal/mol", "TotEng": "kcal/mol", "Temp": "K", "Press": "atm", "Vol": "A³", "Volume": "A³"}
ELEMENT_MASSES = {"H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Li": 6.94, "Na": 22.990, "Mg": 24.305, "P": 30.974, "S": 32.06, "Cl": 35.45, "Br": 79.904, "I": 126.904}
ELEMENT_RADII = {"H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "F": 1.47, "Li": 1.82, "Na": 2.27, "Mg": 1.73, "P": 1.80, "S": 1.80, "Cl": 1.75, "Br": 1.85, "I": 1.98}
DIAMETER_SCALE, CONTEXT_DIAMETER, UNKNOWN_DIAMETER = 0.50, 0.55, 0.65


def bond_type(order: Column) -> Column:
    """Triple from 2.5, double from 1.5, else single."""
    return F.when(order >= 2.5, 3).when(order >= 1.5, 2).otherwise(1).cast("int")


def map_elements(atoms: DataFrame, elements: DataFrame, how: str = "inner") -> DataFrame:
    """Adds element by atom_type: unknown types are left out (inner) or stay with null (left)."""
    return atoms.join(F.broadcast(elements), "atom_type", how)


def box_lengths(df: DataFrame) -> DataFrame:
    """Adds lx, ly, lz and volume."""
    return df.withColumns({f"l{a}": F.col(f"{a}hi") - F.col(f"{a}lo") for a in "xyz"}).withColumn("volume", F.col("lx") * F.col("ly") * F.col("lz"))


def wrap(u: Column, lo: Column, length: Column) -> Column:
    """An unwrapped coordinate in its periodic box."""
    return lo + F.pmod(u - lo, length)


def minimum_image(d: Column, length: Column) -> Column:
    """A difference of coordinates to the nearest periodic image (halves round to even)."""
    return d - length * F.rint(d / length)


def distance(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def quoted(label: Column) -> Column:
    """A label as a Python string literal: single quotes, or double ones around a lone single quote."""
    escaped = F.replace(label, F.lit("\\"), F.lit("\\\\"))
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), escaped, F.lit('"'))
    return F.when(label.contains("'") & ~label.contains('"'), double).otherwise(single)


def listing(labels: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(labels), quoted), ", "), F.lit("]"))


def format_reaction(reactants: Column, products: Column) -> Column:
    """\"['A', 'B'] -> ['C']\" with sorted sides; an empty side is []."""
    return F.concat(listing(reactants), F.lit(" -> "), listing(products))


def changed(reactants: Column, products: Column) -> Column:
    """Whether the sides differ as sets: how often a label stands does not count."""
    return F.sort_array(F.array_distinct(reactants)) != F.sort_array(F.array_distinct(products))


def thermo_axis_label(parameter: Column) -> Column:
    unit = F.coalesce(*(F.when(parameter == k, F.lit(u)) for k, u in THERMO_UNITS.items()))
    return F.when(unit.isNotNull(), F.concat(parameter, F.lit(" ("), unit, F.lit(")"))).otherwise(parameter)


def padded_range(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Sorted bounds; equal ones are padded by a hundredth of their size, one at least."""
    a, b = F.least(lo, hi), F.greatest(lo, hi)
    pad = F.when(a == b, F.greatest(F.abs(a) * 0.01, F.lit(1.0))).otherwise(0.0)
    return a - pad, b + pad


def hill(elements_counts: Column) -> Column:
    """A formula from array<struct<element, n>>: C, H and then the alphabet; without C the alphabet alone."""
    carbon = F.exists(elements_counts, lambda x: x.element == "C")
    key = lambda e: F.when(carbon & (e == "C"), 0).when(carbon & (e == "H"), 1).otherwise(2)
    ordered = F.array_sort(F.transform(elements_counts, lambda x: F.struct(key(x.element).alias("k"), x.element.alias("element"), x.n.alias("n"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat(x.element, F.when(x.n > 1, x.n.cast("string")).otherwise(""))), "")


def composition(formula: Column) -> Column:
    """array<struct<element, n>> by element, of a formula in any order (C3H4O3Li, OLi2, LiOLi): counts of repeated elements
    add up, none is 1. Null for text that is no formula."""
    whole = formula.rlike(r"^([A-Z][a-z]?[0-9]*)+$")
    parts = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9]*)"), F.lit(0))
    each = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, "^[A-Za-z]+", 0).alias("element"), F.coalesce(F.expr("1") * F.nullif(F.regexp_extract(x, "[0-9]+$", 0), F.lit("")).cast("bigint"), F.lit(1).cast("bigint")).alias("n")))
    names = F.array_sort(F.array_distinct(F.transform(each, lambda x: x.element)))
    total = lambda e: F.aggregate(F.filter(each, lambda x: x.element == e), F.lit(0).cast("bigint"), lambda a, x: a + x.n)
    return F.when(whole, F.filter(F.transform(names, lambda e: F.struct(e.alias("element"), total(e).alias("n"))), lambda x: x.n > 0))


def composition_key(formula: Column) -> Column:
    """One text for all orders in which a formula may be written: its elements by name, each with its count."""
    return F.array_join(F.transform(composition(formula), lambda x: F.concat(x.element, x.n.cast("string"))), " ")

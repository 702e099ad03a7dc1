"""Mass constants, the residue and ion dimensions, and mass column expressions.

Masses are BIGINT units of 1e-4 Da everywhere (``_u`` suffix), so that two engines
agree exactly. Tolerances are parameters in the same unit.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Public physical constants and monoisotopic residue masses, in 1e-4 Da.
UNIT = 10_000
PROTON = 10_073
ISOTOPE_STEP = 10_033
WATER = 180_106
AMMONIA = 170_266
CARBON_MONOXIDE = 279_949
WATER_PROTON = 190_184
RESIDUE_MASS = {
    "G": 570_215,
    "A": 710_371,
    "S": 870_320,
    "P": 970_528,
    "V": 990_684,
    "T": 1_010_477,
    "C": 1_030_092,
    "I": 1_130_841,
    "L": 1_130_841,
    "N": 1_140_429,
    "D": 1_150_269,
    "Q": 1_280_586,
    "K": 1_280_950,
    "E": 1_290_426,
    "M": 1_310_405,
    "H": 1_370_589,
    "F": 1_470_684,
    "R": 1_561_011,
    "Y": 1_630_633,
    "W": 1_860_793,
}
# Edges use one label per distinct mass: I and L weigh the same.
EDGE_RESIDUES = {aa: m for aa, m in RESIDUE_MASS.items() if aa != "I"}
# name -> (orientation, charge, offset, parent, strong)
IONS = {
    "b": ("prefix", 1, PROTON, None, True),
    "y": ("suffix", 1, WATER_PROTON, None, True),
    "a": ("prefix", 1, PROTON - CARBON_MONOXIDE, "b", False),
    "b-H2O": ("prefix", 1, PROTON - WATER, "b", False),
    "y-H2O": ("suffix", 1, WATER_PROTON - WATER, "y", False),
    "b2": ("prefix", 2, 2 * PROTON, None, False),
    "y2": ("suffix", 2, WATER_PROTON + PROTON, None, False),
}


def precursor_mass(mz: Column, charge: Column, proton: int = PROTON) -> Column:
    """[M+H] of an ion seen at ``mz`` with ``charge``."""
    return mz * charge - (charge - 1) * F.lit(proton)


def precursor_mz(pm: Column, charge: Column, proton: int = PROTON) -> Column:
    """Inverse of :func:`precursor_mass`, rounded down to whole units."""
    return F.floor((pm + (charge - 1) * F.lit(proton)) / charge).cast("bigint")


def residue_map(masses: dict[str, int] = RESIDUE_MASS) -> Column:
    """Residue label -> mass as a literal map, for use inside row expressions."""
    return F.create_map(*[F.lit(x) for kv in masses.items() for x in (kv[0], F.lit(kv[1]).cast("bigint"))])


def residue_structs(masses: dict[str, int] = EDGE_RESIDUES) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("residue"), F.lit(m).cast("bigint").alias("mass")) for a, m in masses.items()])


def ion_structs(names: list[str] | None = None) -> Column:
    """The ion dimension as an array literal: exploding it needs no join."""
    rows = []
    for name in names or list(IONS):
        orientation, charge, offset, parent, strong = IONS[name]
        rows.append(
            F.struct(
                F.lit(name).alias("ion"),
                F.lit(orientation).alias("orientation"),
                F.lit(charge).cast("int").alias("ion_charge"),
                F.lit(offset).cast("bigint").alias("offset_u"),
                F.lit(parent).cast("string").alias("parent"),
                F.lit(strong).alias("strong"),
            )
        )
    return F.array(*rows)


def peptide_mass(peptide: Column) -> Column:
    """Sum of residue masses of a plain one-letter peptide."""
    table = residue_map()
    return F.aggregate(F.split(peptide, ""), F.lit(0).cast("bigint"), lambda acc, r: acc + F.coalesce(table[r], F.lit(0)))


def size_class(mass: Column, thresholds: list[int]) -> Column:
    """Index of the first threshold above the mass; the last class is open."""
    expr = F.lit(len(thresholds))
    for i in range(len(thresholds) - 1, -1, -1):
        expr = F.when(mass < thresholds[i], F.lit(i)).otherwise(expr)
    return expr.cast("int")

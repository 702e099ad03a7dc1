"""Modification tables: rules with a place in the sequence, joined to residue tokens.

A rule is (residue, shift_u, fixed, region, place, symbol, name). ``residue`` is a letter, ``N_TERM`` or
``C_TERM``; ``region`` is ``ALL``, ``N_TERM``, ``C_TERM`` or ``PLACE``, for which ``place`` counts residues from 1,
or from -1 at the end. Terminal symbols, such as ``^+42`` and ``$-1``, are tokens of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from peakloom.functions import mass

RULE_SCHEMA = "residue string, shift_u bigint, fixed boolean, region string, place int, symbol string, name string"
TERMINALS = ("N_TERM", "C_TERM")
#: A residue or terminal mark with an optional whole shift.
TOKEN = r"[A-Z^$](?:[+-][0-9]+)?"


def chosen_rules(rules: DataFrame, symbols: str) -> DataFrame:
    """The rules of a list such as ``C+57:M+16``. A fixed one must hold everywhere; terminal ones count as optional."""
    wanted = [s for s in symbols.split(":") if s]
    picked = rules.filter(F.col("symbol").isin(wanted))
    optional = F.col("region").isin(*TERMINALS) | F.col("residue").isin(*TERMINALS)
    fixed = F.col("fixed") & ~optional
    message = F.concat(F.lit("a fixed modification must hold everywhere: "), F.col("symbol"))
    checked = picked.withColumn("fixed", F.when(fixed & (F.col("region") != "ALL"), F.raise_error(message).cast("boolean")).otherwise(fixed))
    missing = sorted(set(wanted) - {r[0] for r in checked.select("symbol", "fixed").collect()})  # a list of a few symbols
    if missing:
        raise ValueError(f"no rule for {', '.join(missing)}")
    return checked


def token_table(rules: DataFrame) -> DataFrame:
    """(token, mass_u, region, place): letters with their fixed changes, and the tokens of optional rules."""
    letters = rules.sparkSession.createDataFrame(list(mass.RESIDUE_MASS.items()), "residue string, base_u bigint")
    fixed = rules.filter("fixed").groupBy("residue").agg(F.sum("shift_u").alias("fixed_u"))
    based = letters.join(fixed, "residue", "left").select("residue", (F.col("base_u") + F.coalesce("fixed_u", F.lit(0))).alias("mass_u"))
    plain = based.select(F.col("residue").alias("token"), "mass_u", F.lit("ALL").alias("region"), F.lit(0).alias("place"))
    optional = rules.filter("not fixed").join(based, "residue", "left").select(
        F.col("symbol").alias("token"), (F.coalesce("mass_u", F.lit(0)) + F.col("shift_u")).alias("mass_u"),
        F.when(F.col("residue") == "N_TERM", "BEFORE").when(F.col("residue") == "C_TERM", "AFTER").otherwise(F.col("region")).alias("region"), "place",
    )
    return plain.unionByName(optional)


def sequence_tokens(df: DataFrame, keys: Sequence[str], col: str = "peptide") -> DataFrame:
    """(keys, token, at, n, clean): tokens with their residue position from 0; marks before and after are at -1 and n."""
    body = F.regexp_replace(col, r"^\[[0-9]+\]", "")
    found = F.regexp_extract_all(body, F.lit(f"({TOKEN})"), 1)
    listed = df.select(*keys, found.alias("t"), (F.regexp_replace(body, TOKEN, "") == "").alias("clean"))
    before = F.when(F.coalesce(F.try_element_at("t", F.lit(1)).startswith("^"), F.lit(False)), 1).otherwise(0)
    after = F.when((F.size("t") > 0) & F.coalesce(F.try_element_at("t", F.lit(-1)).startswith("$"), F.lit(False)), 1).otherwise(0)
    counted = listed.select(*keys, "clean", before.alias("before"), (F.size("t") - before - after).alias("n"), F.posexplode_outer("t").alias("i", "token"))
    return counted.select(*keys, "token", (F.col("i") - F.col("before")).alias("at"), "n", "clean")


def masses_by_rules(df: DataFrame, keys: Sequence[str], rules: DataFrame, col: str = "peptide") -> DataFrame:
    """(keys, n_residues, n_modified, valid, mass_u) of each sequence under the chosen rules.

    A token is allowed where its rule's place fits; with any token that is unknown or out of place the
    sequence is not valid and has no mass. A leading gap ``[mass]`` is not counted. ``keys`` identify a row;
    a null or empty sequence has no residues and mass 0.
    """
    at, n, place = F.col("at"), F.col("n"), F.col("place")
    region = F.col("region")
    fits = (
        ((region == "ALL") & (at >= 0) & (at < n))
        | ((region == "N_TERM") & (at == 0))
        | ((region == "C_TERM") & (at == n - 1))
        | ((region == "BEFORE") & (at == -1))
        | ((region == "AFTER") & (at == n))
        | ((region == "PLACE") & (at == F.when(place > 0, place - 1).otherwise(n + place)))
    )
    tokens = sequence_tokens(df, keys, col).join(token_table(rules), "token", "left")
    good = F.col("token").isNull() | F.coalesce(fits, F.lit(False))
    sums = tokens.groupBy(*keys).agg(
        F.first("n").alias("n_residues"), F.count_if(F.length("token") > 1).alias("n_modified"), (F.bool_and(good) & F.coalesce(F.first("clean"), F.lit(True))).alias("valid"),
        F.coalesce(F.sum("mass_u"), F.lit(0)).alias("sum_u"),
    )
    return sums.select(*keys, "n_residues", "n_modified", "valid", F.when(F.col("valid"), F.col("sum_u")).alias("mass_u"))

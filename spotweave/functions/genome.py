"""Bases, contexts and sequence checks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of bases in vectors and ties.
BASES = ("A", "T", "C", "G")


def complement(base: Column) -> Column:
    return F.translate(base, "ATCG", "TAGC")


def base_rank(base: Column) -> Column:
    """Place of a base in BASES, from 0."""
    return F.when(base == "A", 0).when(base == "T", 1).when(base == "C", 2).when(base == "G", 3)


def _mutation(up: Column, ref: Column, alt: Column, down: Column) -> Column:
    return F.concat(up, F.lit("["), ref, F.lit(">"), alt, F.lit("]"), down)


def context_dna96(up: Column, ref: Column, alt: Column, down: Column) -> Column:
    """up[ref>alt]down with the pyrimidine as reference."""
    return F.when(ref.isin("C", "T"), _mutation(up, ref, alt, down)).otherwise(_mutation(complement(down), complement(ref), complement(alt), complement(up)))


def context_rna192(up: Column, ref: Column, alt: Column, down: Column, strand: Column) -> Column:
    """up[ref>alt]down as transcribed: turned round on the minus strand."""
    return F.when(strand == "-", _mutation(complement(down), complement(ref), complement(alt), complement(up))).otherwise(_mutation(up, ref, alt, down))


def gc_content(sequence: Column) -> Column:
    """Share of G and C, upper case only; null for an empty sequence."""
    return F.when(F.length(sequence) > 0, F.regexp_count(sequence, F.lit("[GC]")) / F.length(sequence))


def cause_poly_alt(left5: Column, alt: Column, right5: Column) -> Column:
    """Whether the change makes a run of six."""
    return F.contains(F.concat(left5, alt, right5), F.repeat(alt, F.lit(6)))


def homopolymer(sequence: Column, run: int = 6) -> Column:
    """The base of the run of six nearest to the middle (first of A, T, C, G on a tie); null without one."""
    middle = (F.length(sequence) + 1) / 2
    runs = "|".join(f"{b}{{{run},}}" for b in BASES)
    # What is between runs, and the runs: a run's place is the sum of all lengths before it.
    pieces = F.arrays_zip(F.split(sequence, runs, -1).alias("before"), F.regexp_extract_all(sequence, F.lit(f"({runs})"), F.lit(1)).alias("run"))
    none = F.lit(None).cast("struct<d:double,i:int,b:string>")

    def step(at: Column, piece: Column) -> Column:
        start = at["next"] + F.length(piece["before"])
        end = start + F.length(piece["run"])
        base = F.substr(piece["run"], F.lit(1), F.lit(1))
        d = F.greatest(start - middle, middle - (end - 1), F.lit(0.0))
        found = F.when(piece["run"].isNotNull(), F.struct(d.alias("d"), base_rank(base).alias("i"), base.alias("b")))
        return F.struct(F.coalesce(end, start).alias("next"), F.least(at["best"], found).alias("best"))

    return F.aggregate(pieces, F.struct(F.lit(1).alias("next"), none.alias("best")), step)["best"]["b"]


def chromosome_order(chrom: Column) -> list[Column]:
    """Sort keys: 1 to 22, X, Y, M, then the rest by name."""
    name = F.regexp_replace(chrom, "^chr", "")
    number = F.when(name.rlike("^[0-9]+$"), name.cast("int")).when(name == "X", 23).when(name == "Y", 24).when(name.isin("M", "MT"), 25).otherwise(1000)
    return [number, name]

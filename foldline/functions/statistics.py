"""Statistics of local alignment scores as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scoring:
    """Karlin-Altschul values; the defaults are the published ones of BLOSUM62 with gap costs 11 and 1."""

    lambda_gapped: float = 0.267
    kappa_gapped: float = 0.041
    alpha: float = 1.9
    beta: float = -30.0
    lambda_ungapped: float = 0.3176
    kappa_ungapped: float = 0.134
    opening: int = 11
    extension: int = 1

    def cut_offs(self) -> dict[str, int]:
        """Raw scores: drop-offs of ungapped (7 bits), gapped (15) and final extension (25), and what ungapped hits need (22 bits)."""
        ln2 = math.log(2)
        return {
            "drop_ungapped": int(7 * ln2 / self.lambda_ungapped + 1),
            "drop_gapped": int(15 * ln2 / self.lambda_gapped),
            "drop_final": int(25 * ln2 / self.lambda_gapped),
            "least_ungapped": int((22 * ln2 + math.log(self.kappa_ungapped)) / self.lambda_ungapped),
        }


def length_adjustment(query: Column, letters: Column, count: Column, scoring: Scoring = Scoring()) -> Column:
    """By how much alignments shorten a query and each of count databank sequences with so many letters together: the
    largest whole l with l <= beta + alpha / lambda * ln(K (m - l)(n - N l)), such that K (m - l)(n - N l) > max(m, n); 0 if there is none.

    What l is compared with falls as l grows, so l is found bit by bit.
    """
    m, n, many = query.cast("double"), letters.cast("double"), count.cast("double")
    k = scoring.kappa_gapped

    def fits(ell: Column) -> Column:
        room = (m - ell) * (n - many * ell)
        possible = (ell < m) & (many * ell < n) & (k * room > F.greatest(m, n))
        return possible & (scoring.beta + scoring.alpha / scoring.lambda_gapped * F.log(F.greatest(k * room, F.lit(1e-9))) >= ell)

    bits = F.array(*[F.lit(float(1 << b)) for b in range(22, -1, -1)])
    found = F.aggregate(bits, F.lit(0.0), lambda ell, bit: F.when(fits(ell + bit), ell + bit).otherwise(ell))
    return found.cast("long")


def search_space(query: Column, letters: Column, count: Column, scoring: Scoring = Scoring()) -> Column:
    ell = length_adjustment(query, letters, count, scoring)
    return (query - ell) * (letters - count * ell)


def bit_score(score: Column, scoring: Scoring = Scoring()) -> Column:
    return F.floor((scoring.lambda_gapped * score - math.log(scoring.kappa_gapped)) / math.log(2))


def expectation(bits: Column, space: Column) -> Column:
    return space / F.pow(F.lit(2.0), bits)


def merged_hits(hsps: Column, space: Column, most: float, scoring: Scoring = Scoring()) -> Column:
    """The array hsps (score, q_start, q_end, t_start, t_end) of one target, best first, without those that overlap a better one on
    both sides or are expected more than `most` times; with bits and expect."""
    ranked = F.array_sort(hsps, lambda a, b: F.when(a["score"] != b["score"], F.signum(b["score"] - a["score"]).cast("int")).when(a["q_start"] != b["q_start"], F.signum(a["q_start"] - b["q_start"]).cast("int")).otherwise(F.signum(a["t_start"] - b["t_start"]).cast("int")))

    def overlaps(a: Column, b: Column) -> Column:
        return (a["q_end"] >= b["q_start"]) & (a["q_start"] <= b["q_end"]) & (a["t_end"] >= b["t_start"]) & (a["t_start"] <= b["t_end"])

    kept = F.aggregate(ranked, F.filter(ranked, lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda y: overlaps(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    scored = F.transform(kept, lambda x: x.withField("bits", bit_score(x["score"], scoring)).withField("expect", expectation(bit_score(x["score"], scoring), space)))
    return F.filter(scored, lambda x: x["expect"] <= most)

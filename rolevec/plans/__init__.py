"""End-to-end plans built from the operators."""

from rolevec.plans.dimred import Reduction, reduce_dimensions
from rolevec.plans.sweep import sweep
from rolevec.plans.two_round import TwoRounds, two_round_clustering
from rolevec.plans.vectorize import Vectorized, vectorize

__all__ = ["Reduction", "TwoRounds", "Vectorized", "reduce_dimensions", "sweep", "two_round_clustering",
           "vectorize"]

"""Rules, recursion and lattices over Spark DataFrames."""

from quillon.plans.engine import Engine, IterationLimitExceeded, StratificationError, absent, agg, any_of, atom, each, let, span, where

__all__ = ["Engine", "IterationLimitExceeded", "StratificationError", "absent", "agg", "any_of", "atom", "each", "let", "span", "where"]

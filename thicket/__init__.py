"""Thicket: Bayesian sums of trees and bandit analytics on Spark DataFrames."""

__version__ = "0.1.0"

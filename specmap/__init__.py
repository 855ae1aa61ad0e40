"""Coordinates for a set of one-dimensional profiles, and label transfer, as Spark dataflows.

sources    spectra tables: schema, coercion, parquet, .npz, in-memory arrays, views over other tables
functions  Arrow batch helpers, distance kernels, distributed ranks and exact quantiles, hub-safe joins
operators  one module per step: preprocess, distance, neighbours, graph, geodesics, coordinates, refine,
           solve, transfer, evaluate
plans      Config and fit(): the steps composed into one dataflow
"""
from .plans.config import Config
from .plans.pipeline import Fit, fit

__all__ = ["Config", "Fit", "fit"]
__version__ = "0.1.0"

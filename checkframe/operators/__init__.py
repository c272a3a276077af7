"""Validation runs over DataFrames."""

from .engine import Result, Checker
from .model import Dive, Field, MapDive, Model, model_of

__all__ = ["Dive", "Field", "MapDive", "Model", "Result", "Checker", "model_of"]

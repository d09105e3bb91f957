"""Hourly (or any fixed-step) keyed time series on Spark."""

from tidemark.operators.errors import DataContractError
from tidemark.operators.series import HOURLY, Series
from tidemark.session import build_session

__all__ = ["DataContractError", "HOURLY", "Series", "build_session"]

"""Spark operators for the data around supervised fine-tuning runs."""

from sftlens.session import get_spark

__all__ = ["get_spark"]

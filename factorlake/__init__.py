"""Panel time-series and cross-sectional factor research on Spark DataFrames."""

from factorlake.session import build_session

__all__ = ["build_session"]

"""plantspark: chiller-plant and building telemetry analytics on Spark DataFrames."""

from plantspark.session import local_session, tune

__all__ = ["local_session", "tune"]

"""prefspark: preference-data and policy-objective analytics on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, so Catalyst can prune, push down and plan it.
"""

from prefspark.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]

"""dialectic — thread and preference data on Spark.

Every operator is a function ``DataFrame(s) + parameters -> DataFrame``;
the work is declared with the DataFrame API and left to Catalyst/AQE.
"""

from dialectic.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]

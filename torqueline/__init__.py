"""Vehicle-telemetry analytics on Spark.

Every public function takes and returns DataFrames (or Columns).  Operators whose
result depends on the data itself (which columns survive, medians, bounds of hot
series) run one narrow statistics job and then hand back a lazy plan.
"""

from torqueline.session import build_session, prepare, settle, shared_dir

__all__ = ["build_session", "prepare", "settle", "shared_dir"]

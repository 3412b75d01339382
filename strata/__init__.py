"""strata: profiling, cleaning, encoding, clustering and scoring of wide tables as Spark jobs.

Every operator takes a DataFrame plus column names and returns a DataFrame (or a small
fitted-model object whose ``transform`` returns one).  Nothing larger than
O(features^2 + k * features) scalars is brought to the driver.
"""

from strata.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"

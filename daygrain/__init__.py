"""daygrain: daily sensor features and calibrated probability ensembles on Spark.

Every operator takes and returns a lazy ``pyspark.sql.DataFrame``; nothing on
the data path is collected to the driver except small, size-bounded
vocabularies and parameter tables.
"""

from daygrain.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]

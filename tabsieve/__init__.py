"""tabsieve: profile, clean, encode and split large tables with the Spark DataFrame API.

Every operator is a function ``DataFrame -> DataFrame`` (usable with ``df.transform``) built on
public PySpark functions; nothing is collected to the driver except schemas, one-row statistics
and explicitly size-checked vocabularies.
"""

from tabsieve.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]

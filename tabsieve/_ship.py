"""Make UDF code travel with the task.

Python UDFs defined in this package are pickled *by value* (cloudpickle's public
``register_pickle_by_value``), so executors need no installed copy of the package and the result
does not depend on the driver's working directory.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module_name: str) -> None:
    module = sys.modules.get(module_name)
    if module is not None:
        try:
            cloudpickle.register_pickle_by_value(module)
        except ValueError:
            pass  # already registered

"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries only when it can be imported.  Task functions are pickled by
value, so executors need numpy and pyarrow but not this package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

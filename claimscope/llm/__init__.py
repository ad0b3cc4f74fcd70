"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Each operator module has
its own general interface; :mod:`claimscope.llm.queries` holds the thin
registered queries. Every operator takes a DataFrame, reads only the columns it
is told to, and gives nulls, empty texts, repeated rows and empty tables the
result its docstring states.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Corpus operators for preparing language-model training data.

Nothing else in the library imports this package.  Its task functions are
pickled by value, so executors need the third-party libraries but not this
package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

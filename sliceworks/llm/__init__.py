"""Operators for preparing training text; nothing else in the library imports this subpackage.

Functions defined here travel to the workers by value, so that executors need not have the
package installed.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators that prepare training data: fingerprints, near copies, toxicity, quality, language,
personal data, rules, repeated passages, mixing and packing.

Nothing else in the library imports this package. ``notelake.llm.queries`` holds the registered
queries; ``corpus_pipeline.py`` at the repository top chains five of the operators.
"""

import notelake
from pyspark import cloudpickle

# Task functions travel by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(notelake)

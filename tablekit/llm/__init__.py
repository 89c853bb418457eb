"""Operators of a training-data pipeline (fingerprints, deduplication, language
identification, personal data, tokenisation, packing, chat formatting).

Nothing else in the library imports this subpackage. ``queries`` registers one
query per operator; ``corpus_pipeline.py`` at the repository top chains five of
them. Every operator takes a DataFrame and returns a DataFrame; texts are
processed whole, and a null text counts as an empty one.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# the functions that run in Python workers travel with the job, so the package
# need not be installed on the executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])

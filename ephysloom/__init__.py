"""Spark-native analysis of multichannel event-locked recordings.

The library is a set of DataFrame transformations.  Everything SQL can express
stays a lazy Catalyst plan; numerical kernels run as grouped or batched Arrow
functions.  ``operators`` holds the algebra, ``llm`` the operators for corpora
and ``plans`` the named queries.  The README lists what is still missing.
"""

__version__ = "0.1.0"

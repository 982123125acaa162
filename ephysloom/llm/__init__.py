"""Operators for text corpora and model data.  Optional: nothing else in the
library imports this subpackage."""

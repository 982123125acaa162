"""Numerical kernels in numpy: functions of one signal, map or matrix.

They know nothing of the engine; ``operators.kernels`` and ``operators.models``
run them in Arrow batches, one row or one small task at a time.
"""

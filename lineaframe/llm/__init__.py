"""Training-data operators.

Nothing else in the library imports this subpackage; it may be deleted whole.
Every operator takes the columns it needs by name and never depends on the
other columns of its input, so extra columns (even ones that share a name with
an output column) do no harm.
"""

"""Training-data operators: one module per operator, queries in ``queries.py``.

Nothing else in the library imports this subpackage. All operators share these
rules: they read only the id and text columns named in their arguments, so other
columns may have any name; a null text counts as an empty text; intermediate
tables go to the folder in ``spark.checkpoint.dir`` only.
"""

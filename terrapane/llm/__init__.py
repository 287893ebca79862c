"""Training-data operators over the ``documents``-shaped tables.

Nothing outside this package imports it.  ``registry`` holds the queries.
"""

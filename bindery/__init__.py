"""Set-oriented analytics over commercial-insurance submissions, on PySpark.

Every operator is a function ``DataFrame -> DataFrame`` (or a Column builder)
composed with ``DataFrame.transform``; no module holds state.
"""

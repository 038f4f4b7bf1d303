"""apiatlas: web-API and JSON-structure catalogs over text/code corpora, as Spark jobs.

Every job is a function ``DataFrame -> DataFrame`` built from Spark's own
functions, joins, windows and aggregates (see ``apiatlas.operators``).
"""

__version__ = "0.1.0"

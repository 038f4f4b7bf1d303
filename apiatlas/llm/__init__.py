"""Training-data operators: text, page and vector jobs run as Spark plans.

Nothing else in the package imports this subpackage.
"""

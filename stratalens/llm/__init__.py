"""Operators for preparing training data of language models.

Nothing else in the package imports this folder. Executors must be able to import the
package (``--py-files`` or a common PYTHONPATH), as for any Spark job with Python tasks.
"""

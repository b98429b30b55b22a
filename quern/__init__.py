"""quern: a PySpark-native engine for source-grounded document retrieval and corpus preparation.

Everything is declared with the DataFrame / SQL API; Python runs only in Arrow batches and only
where no built-in expression has the semantics.
"""

__version__ = "0.1.0"

"""litspark: literature retrieval and evaluation as batch Spark jobs.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns; nothing runs until the caller acts on the result, except the size
checks named in :mod:`litspark.sizing`.
"""

__version__ = "0.1.0"

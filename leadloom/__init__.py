"""leadloom: lead-scoring data work as Spark DataFrame operators.

``sources``    delimited scans, sinks, output naming
``functions``  fixed values and Column expressions
``operators``  DataFrame -> DataFrame building blocks
``plans``      Spark ML stages and the append / train / score / insight jobs
``streaming``  the same jobs on Structured Streaming micro-batches
"""

__version__ = "0.1.0"

"""Spark-first analytics for periodic leaderboard snapshots.

Every operator is a plain function from DataFrame to DataFrame.  Sub-packages:

* ``sources``    readers, sheet and token-document parsers, writers
* ``functions``  reusable column expressions and Arrow UDFs
* ``operators``  the relational, analytic and data-quality operators
* ``plans``      named queries over the test tables and their SQL twins
* ``streaming``  the same operators as Structured Streaming pipelines
* ``llm``        operators for training-data pipelines; nothing else imports it
"""

__version__ = "0.1.0"

"""synthlab: Spark-native toolkit for synthetic-data augmentation experiments on tables.

Every public operator is a function ``DataFrame -> DataFrame`` built from Spark's own
relational operators (scans, projections, joins, aggregates, windows).  No operator
triggers an action except MLlib model fits and the explicit sinks in ``sources``.
"""

__version__ = "0.1.0"

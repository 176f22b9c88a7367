"""foliomine: a Spark-native engine for document retrieval and its analytics.

Everything is a DataFrame -> DataFrame function.  ``operators`` hold the relational and text operators,
``functions`` the column expressions they share, ``sources`` the readers and writers, ``streaming`` the
stateful twins, ``plans`` the query catalogue with its SQL twins.
"""

"""Spark-native retrieval, memory, session analytics and corpus preparation.

``functions``  column expressions, ``operators`` DataFrame -> DataFrame steps,
``sources`` readers and writers, ``plans`` whole queries, ``streaming`` stateful
rules.  ``llm`` holds the training-data operators; nothing here imports it.
"""

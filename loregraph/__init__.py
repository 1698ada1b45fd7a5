"""Loregraph: knowledge-base retrieval and analysis as set-oriented Spark jobs."""

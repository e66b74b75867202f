"""Land-cover analytics as Spark DataFrame jobs.

``functions``  column expressions (no shuffle, JVM-side)
``sources``    discovery, scans, configuration documents, sinks
``operators``  raster, point, vector, morphology, metric and ML jobs
``streaming``  incremental ingest and live boards
``plans``      the registered queries that wire the above to tables
"""

"""Repository-registry analytics as PySpark jobs.

Sub-packages: ``functions`` (column expressions), ``sources`` (scans and sinks),
``operators`` (DataFrame -> DataFrame steps), ``plans`` (whole pipelines and the
query catalog) and ``streaming`` (the incremental path).
"""

__version__ = "0.1.0"

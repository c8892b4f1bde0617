"""lamella: volumetric image arrays and their file streams as Spark tables.

Operators live in ``operators`` (DataFrame transforms), ``functions`` (column
expressions), ``sources`` (Python data sources and sinks), ``streaming``
(stateful stream jobs) and ``plans`` (registered queries with their SQL twins).
"""

__version__ = "0.1.0"

"""quire: authorship-attribution data work as Spark DataFrame jobs.

Every public function takes DataFrames and returns DataFrames; nothing is
collected to the driver except scalar aggregates (counts used to size blocks).
"""

__version__ = "0.1.0"

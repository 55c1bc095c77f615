"""assay: tabular data preparation, resampling and model evaluation on Spark.

Every operator is a function from DataFrame(s) to DataFrame built on native
Spark SQL expressions.  Learned operators come as a ``fit_*`` that returns a
small statistics DataFrame (one row, or one row per class / feature) and an
``apply_*`` that joins it back; nothing row-sized passes through the driver.
"""

__version__ = "0.1.0"

"""covey: multivariate similarity search over aligned series, as PySpark DataFrames."""

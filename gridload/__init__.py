"""PySpark operators for energy-demand time series."""

"""terrapane: gridded satellite-raster time series on Spark.

Pixels and patches are DataFrames; quality flags, calibration, cloud fusion, gridding, resampling, compositing, windowed features and
smoothing are Column expressions, joins, windows and grouped Arrow functions over them.
"""

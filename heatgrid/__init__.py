"""heatgrid: urban heat and land-cover analytics as Spark DataFrame jobs."""

"""gridrun: raster and vector survey analytics as Spark DataFrame operators.

Class maps are stored as row-runs ``(raster_id, row, c0, c1, class_id)``;
label burning, morphology, components, proximity, accuracy metrics, village
reports and visit queues are joins, windows and aggregations over them.
"""

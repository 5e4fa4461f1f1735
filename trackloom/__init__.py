"""Trajectory analytics on Spark: detections, smoothed tracks, flows, outliers, features, classifiers."""

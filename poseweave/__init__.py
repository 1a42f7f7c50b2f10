"""Trajectory and signed-distance-field analytics as Spark DataFrame operators."""

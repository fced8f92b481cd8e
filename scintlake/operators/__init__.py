"""Distributed operators: joins, grouped statistics, correlations and calibration passes."""

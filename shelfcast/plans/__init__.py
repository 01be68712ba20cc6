"""Composed plans: forecasters, experiment, report, order plan."""

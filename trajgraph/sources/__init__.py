"""Readers and writers for trajectories, logs, app tables, samples and exports."""

"""Descriptions of workloads."""

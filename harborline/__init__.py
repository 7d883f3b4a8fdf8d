"""Freight analytics as Spark DataFrames: loads, dashboards, forecasts, routing and live KPIs."""

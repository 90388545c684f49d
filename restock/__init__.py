"""Retail demand planning as Spark jobs: snapshot, features, forecast, planning, reports."""

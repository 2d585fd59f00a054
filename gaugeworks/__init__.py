"""gaugeworks: Spark jobs for station time series, forecast verification and history audits."""

"""Finished queries: views, period analytics, diagnostics and the registered query catalogue."""

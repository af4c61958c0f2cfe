"""Usage and cost analytics over coding-assistant session logs, built on PySpark."""

"""Where data comes in and goes out: log files, rate files, stored tables."""

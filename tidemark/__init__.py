"""Signal analytics on PySpark: event bursts, label joins, calibration, backtests and reports as DataFrame functions."""

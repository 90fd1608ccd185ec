"""DataFrame-in, DataFrame-out operators for point-in-time equity analytics."""

"""Row-wise operators over unbounded input."""

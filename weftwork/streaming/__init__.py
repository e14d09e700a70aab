"""The parsing jobs over a stream of log files."""

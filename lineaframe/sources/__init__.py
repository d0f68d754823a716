"""Tables that plans scan: from DataFrames, from snapshots, and how snapshots are made."""

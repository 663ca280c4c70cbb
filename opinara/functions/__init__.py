"""Column functions: everything here returns a `Column` and never runs a job."""

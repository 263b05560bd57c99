"""Reports, digest tables and the jobs that carry out a plan."""

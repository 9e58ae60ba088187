"""Rate-limit audit, job monitoring and stale-job detection, in batch and as streams."""

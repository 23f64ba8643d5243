"""Driver-side parts: errors, hooks, cache, tenancy, locks, retries, capabilities."""

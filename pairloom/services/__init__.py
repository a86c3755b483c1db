"""Model services: requests, retries, prompts and the checks before a run."""

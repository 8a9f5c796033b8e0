"""Files, fetches and chat models in, files out."""

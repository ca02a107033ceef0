"""Basic and sliding windows, replay by epochs, and the Structured Streaming front end."""

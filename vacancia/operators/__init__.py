"""DataFrame-to-DataFrame operators over listings."""

"""The per-page operators over streams of fetched pages."""

"""auditlake: document-audit analytics expressed as Spark DataFrame jobs."""

__all__ = ["functions", "sources", "operators", "plans", "streaming"]

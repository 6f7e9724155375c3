"""spanloom: span-label analytics and corpus preparation as declarative Spark plans."""

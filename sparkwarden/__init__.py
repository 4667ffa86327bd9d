"""Security-findings analytics over text corpora, expressed as Spark DataFrame jobs."""

"""De-identification, claims analytics and re-identification risk as Spark plans."""

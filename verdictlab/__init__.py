"""verdictlab: compare how two versions of a rule set classify one corpus, as Spark DataFrame jobs."""

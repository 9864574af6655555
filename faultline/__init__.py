"""faultline: program-analysis and findings analytics as Spark plans."""

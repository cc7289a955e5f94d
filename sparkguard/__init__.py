"""sparkguard: Spark jobs for the data work behind AI-agent guardrails."""

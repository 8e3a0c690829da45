"""Speech, language-model and grammar analytics as Spark jobs."""

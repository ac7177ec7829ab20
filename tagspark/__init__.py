"""Media-library tagging as Spark jobs: plan, score, diff, apply, report."""

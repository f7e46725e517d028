"""surveyq: analytics over long, citation-bearing documents, as Spark plans."""

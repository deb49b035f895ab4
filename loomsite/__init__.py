"""Website-content analytics as lazy DataFrame-in, DataFrame-out operators on Spark."""

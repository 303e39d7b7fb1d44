"""pagegauge: page-quality gate, reporting analytics and corpus operators on PySpark."""

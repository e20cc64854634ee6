"""draftloom: analytics over archives of architectural drawings, as PySpark DataFrame code."""

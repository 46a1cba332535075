"""curatrix: catalog curation and corpus preparation as PySpark DataFrame transformations."""

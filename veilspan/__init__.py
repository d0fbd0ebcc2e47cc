"""veilspan: reduced-text release and corpus analytics on PySpark DataFrames."""

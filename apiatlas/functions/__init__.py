"""Column expressions shared by the jobs (all JVM-side except the similarity UDF)."""

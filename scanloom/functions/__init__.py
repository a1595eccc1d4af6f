"""Column helpers. All of them build JVM-side expressions; none is a Python UDF."""

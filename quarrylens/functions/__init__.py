"""Column-level building blocks (no shuffles, all JVM-side unless noted)."""

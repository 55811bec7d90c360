"""Column functions; all run in the JVM but for those whose name says `exact`."""

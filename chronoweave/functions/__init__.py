"""Column functions: names, paths, console output, hashes. All run inside the JVM."""

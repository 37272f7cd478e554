"""Plan shapes that several kernels share: driver loops, global ranking, problem classes and timing."""

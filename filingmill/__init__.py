"""Filing intake, employer resolution and listing annotation as Spark jobs."""

__version__ = "0.1.0"

"""tessera: curation, validation and scoring of nested tile-world documents on Spark."""

__version__ = "0.1.0"

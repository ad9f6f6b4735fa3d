"""docflow: document corpora as DataFrames of lines, cell grids, page layouts and media."""

__version__ = "0.1.0"

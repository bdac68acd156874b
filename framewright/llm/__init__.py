"""Training-data operators over document corpora. Nothing else in the library imports this subpackage."""

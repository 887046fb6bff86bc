"""Training-data operators over documents and web pages; nothing else in the library imports this subpackage."""

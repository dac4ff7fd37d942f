"""The shared grammar, the index query compiler and the dataflow graph."""

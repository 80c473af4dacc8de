"""An extension of our own: the same operators on a stream of files."""
